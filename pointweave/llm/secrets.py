"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Native: DataFrame functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.shared import materialise, release

#: The base kinds in their order, and their patterns. The assigned value is group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Strings that the Markov models judge: runs of the characters of keys and identifiers.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Of the text in lower case, what a match of a pattern holds in any case; texts without any of it need no regular expression.
HOLDS = {ASSIGN: ("password", "passwd", "secret", "token", "api"), ACCESS: ("akia",)}

#: Characters of candidates; every other is one class of its own at place 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1


SPAN = "array<struct<start:int,end:int,s:string>>"
#: Code points of the pieces in which a text is cut up where many places of it are looked up.
PIECE = 1024


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine) -> Column:
    """Inclusive running results of an associative combine over an array, which must not hold nulls.

    Each of log2(n) passes combines every element with the one 1, 2, 4, ... places before it, so n elements cost
    n log n and no array is grown by copying.
    """

    def scan(whole: Column) -> Column:
        passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(whole).cast("double"))).cast("int") - 1, F.lit(0)))
        doubled = lambda acc, k: F.transform(acc, lambda x, i: F.coalesce(combine(F.get(acc, (i - F.pow(F.lit(2.0), k)).cast("int")), x), x))
        return F.when(F.size(whole) < 2, whole).otherwise(F.aggregate(passes, whole, doubled))

    return _bind(values, scan)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches of a pattern, or a group of each, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if pattern not in HOLDS:
        return found
    low, some = F.lower(text), F.lit(False)
    for part in HOLDS[pattern]:
        some |= F.contains(low, F.lit(part))
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def pattern_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    Matches are extracted and the text is split at them by the same regular expression; the running sum of the
    lengths of the pieces gives the places, which regular-expression functions do not return themselves.
    """

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = running(F.zip_with(hits, gaps, lambda h, g: F.length(h) + F.length(g)), lambda a, b: a + b)
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("s")))

    return _bind(matches(text, pattern), lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(placed(hits)))


def free_of(spans: Column, taken: Column) -> Column:
    """Those of spans that overlap none of taken.

    Both are sorted together, taken by start and spans by end; the running maximum of the ends of the taken ones that
    start before a span's end then tells whether one reaches into it.
    """
    marks = F.transform(taken, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("kind"), x["end"].alias("top"), x.alias("span")))
    asks = F.transform(spans, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("top"), x.alias("span")))

    def unmet(events: Column) -> Column:
        tops = running(F.transform(events, lambda e: e["top"]), lambda a, b: F.greatest(a, b))
        seen = F.zip_with(events, tops, lambda e, top: F.struct(e.alias("e"), top.alias("top")))
        return F.transform(F.filter(seen, lambda x: (x["e"]["kind"] == 0) & (x["top"] <= x["e"]["span"]["start"])), lambda x: x["e"]["span"])

    free = _bind(F.sort_array(F.concat(marks, asks)), unmet)
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(F.sort_array(free))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds; matches that are too short are dropped after matching, so they still consume text."""
    assigned = F.filter(pattern_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6)
    return {"assign": assigned, "access": pattern_spans(text, ACCESS), "hex": pattern_spans(text, HEX)}


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points; an empty one has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _steps(s: Column) -> Column:
    """Transition numbers of a string: STATES * place of a character + place of the next; places are from 1, 0 for others."""
    places = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return _bind(places, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda x, y: x * STATES + y))


def train_markov(samples: DataFrame, weight: float = 5.0) -> list[float]:
    """Log-likelihood ratio of each character transition, random over ordinary, from samples(s, random boolean).

    Two first-order models, counted by one aggregate. Transitions are smoothed towards the class's own character
    frequencies, worth ``weight`` observations, so that a character that hardly occurs in ordinary identifiers is
    unlikely there after any other. The result has STATES**2 numbers whatever the samples, so it may go to the driver.
    """
    steps = samples.where(F.length("s") >= 2).select("random", F.explode(_steps(F.col("s"))).alias("step"))
    counts = steps.groupBy("random", "step").count().collect()
    logs = {}
    for label in (True, False):
        table = [0.0] * STATES**2
        for r in counts:
            if r["random"] == label:
                table[r["step"]] += r["count"]
        total = sum(table)
        share = [(sum(table[b::STATES]) + 0.5) / (total + 0.5 * STATES) for b in range(STATES)]
        rows = [sum(table[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        logs[label] = [log((table[k] + weight * share[k % STATES]) / (rows[k // STATES] + weight)) for k in range(STATES**2)]
    return [x - y for x, y in zip(logs[True], logs[False], strict=True)]


def markov_score(s: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per character transition; long strings are summed piece by piece."""

    def total(part: Column) -> Column:
        return F.aggregate(_steps(part), F.lit(0.0), lambda a, k: a + F.element_at(ratios, k + 1))

    def by_piece(parts: Column) -> Column:
        joined = F.transform(parts, lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, 1)))
        return F.aggregate(joined, F.lit(0.0), lambda a, p: a + total(p))

    whole = F.when(F.length(s) <= PIECE, total(s)).otherwise(_bind(_pieces(s), by_piece))
    return whole / F.greatest(F.length(s) - 1, F.lit(1))


def calibrated_threshold(samples: DataFrame, ratios: Column, false_rate: float = 1e-2, least_length: int = 12) -> float:
    """The score above which about ``false_rate`` of held-out ordinary strings of least_length or more characters lie.

    Judged on strings with a letter, as candidates have one. At least 0, where both models are as likely, and at most
    what 99 % of the held-out random strings exceed, so that a few odd identifiers do not switch the method off; 0
    without held-out strings.
    """
    scored = samples.where((F.length("s") >= least_length) & F.col("s").rlike("[A-Za-z]")).select("random", markov_score(F.col("s"), ratios).alias("score"))
    cut = lambda of, p: F.percentile(F.when(of, F.col("score")), p)
    row = scored.agg(cut(~F.col("random"), 1 - false_rate).alias("ordinary"), cut(F.col("random"), 0.01).alias("random")).first()
    found = row["ordinary"] if row["ordinary"] is not None else 0.0
    return max(0.0, min(found, row["random"] if row["random"] is not None else found))


def labelled_samples(docs: DataFrame, per_class: int, ordinary_from: DataFrame | None = None) -> DataFrame:
    """(s, random): up to per_class values of base matches in docs, and as many ordinary words of 8 to 40 characters.

    The ordinary words come from ordinary_from, a sample of the documents (None: from all).

    Ordinary are words that no base match has as its value, and whose digits, if any, stand in one place; so keys that
    no pattern labels do not pass for ordinary. Taken in the order of a hash of the string, so that every run takes the same ones.
    """
    text = F.col("text")
    hits = docs.select(F.explode(F.concat(F.filter(matches(text, ASSIGN, 2), lambda v: F.length(v) >= 6), matches(text, ACCESS), matches(text, HEX))).alias("s"))
    words = (docs if ordinary_from is None else ordinary_from).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_-]{8,40}"), F.lit(0))).alias("s"))
    hits = materialise(hits.distinct(), "labelled")
    ordinary = words.where(~F.col("s").rlike(r"^AKIA|[0-9][^0-9]+[0-9]")).distinct().join(hits, "s", "left_anti").withColumn("random", F.lit(False))
    secret = hits.withColumn("random", F.lit(True))
    first = lambda d: d.orderBy(F.xxhash64("s"), "s").limit(per_class)
    return first(secret).union(first(ordinary))


def scan_secrets(docs: DataFrame, threshold: float | None = None, per_class: int = 20_000, train_rows: int = 20_000) -> DataFrame:
    """docs plus spans: array<struct<start, kind_at, end, kind, s>> by start, then kind (assign, access, hex, random).

    The base kinds are fixed patterns over whole texts. The kind random is a run of 20 or more key characters, with a
    letter and a digit, that overlaps no base span and whose mean log-likelihood ratio per character, random strings
    over ordinary identifiers, is above ``threshold`` (None: calibrated on a held-out fifth of the labelled strings).
    The models are trained on values of base matches in all documents and on ordinary words of about train_rows
    distinct texts, those of the smallest share of a hash; per_class strings of each kind, by hash. Only where no
    document holds a labelled secret does the method add nothing.

    Null text is empty and has no spans. Repeated rows have equal spans. Matches that touch do not overlap; of equal
    starts the kinds' order decides. Very long texts cost m log m for m matches. Other columns pass through; a column
    named spans is replaced, as are scratch columns whose names begin with _secret.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = max(docs.count(), 1)
    share = min(1.0, train_rows / total)
    texts = docs.select(text.alias("text"))
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()
    samples = materialise(labelled_samples(texts, per_class, picked), "samples")
    held = F.pmod(F.xxhash64("s", F.lit(5)), F.lit(5)) == 0
    ratios = train_markov(samples.where(~held)) if samples.where("random").head(1) else None

    out = docs.withColumn("text", text).withColumns({f"_secret_{kind}": span for kind, span in base_spans(F.col("text")).items()})
    if ratios is None:
        out = out.withColumn("_secret_random", F.array().cast(SPAN))
    else:
        model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to one constant
        threshold = calibrated_threshold(samples.where(held), model) if threshold is None else threshold
        mixed = lambda x: x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]")
        likely = F.filter(pattern_spans(F.col("text"), CANDIDATE), lambda x: mixed(x) & (markov_score(x["s"], model) > threshold))
        taken = F.concat("_secret_assign", "_secret_access", "_secret_hex")
        out = out.withColumn("_secret_random", _bind(likely, lambda found: free_of(found, taken)))
    release(samples)
    out = out.drop("spans").withColumn("spans", F.sort_array(F.concat(*(_named(k, kind) for k, kind in enumerate(KINDS)))))
    return out.drop(*(f"_secret_{kind}" for kind in KINDS))


def _named(kind_at: int, kind: str) -> Column:
    return F.transform(
        f"_secret_{kind}",
        lambda x: F.struct(x["start"].alias("start"), F.lit(kind_at).alias("kind_at"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["s"].alias("s")),
    )


def spans_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    of_kinds = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(of_kinds, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span of an array sorted by start replaced by the mark; spans that overlap share one.

    The text is cut into pieces of fixed length, so that finding a place does not mean counting from the start.
    """
    at = lambda pieces, k, lo, n: F.substring(F.coalesce(F.get(pieces, k), F.lit("")), lo + 1, n)

    def between(pieces: Column, lo: Column, hi: Column) -> Column:
        first, last = (lo / PIECE).cast("int"), (hi / PIECE).cast("int")
        inside = F.array_join(F.slice(pieces, first + 2, last - first - 1), "")
        several = F.concat(at(pieces, first, lo % PIECE, F.lit(PIECE)), inside, at(pieces, last, F.lit(0), hi % PIECE))
        return F.when(hi <= lo, F.lit("")).when(first == last, at(pieces, first, lo % PIECE, hi - lo)).otherwise(several)

    def marked(tops: Column) -> Column:
        # A span that starts before the end of an earlier one gets no mark of its own.
        opens = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.when(i > 0, F.get(tops, i - 1)).otherwise(F.lit(0)).alias("before")))
        opens = F.filter(opens, lambda x: x["start"] >= x["before"])
        whole = lambda pieces: F.concat(
            F.array_join(F.transform(opens, lambda x: F.concat(between(pieces, x["before"], x["start"]), F.lit(mark))), ""),
            between(pieces, F.element_at(tops, -1), F.length(text)),
        )
        return _bind(_pieces(text), whole)

    return F.when(F.size(spans) == 0, text).otherwise(_bind(running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), marked))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.col("spans"), KINDS[:3]), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), count("random")
    )
