"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

The library loads the vocabulary, and checks ids and decoding in every Arrow batch before the batch is given on.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct chunks a Python worker remembers before it starts afresh; this bounds its memory, not the result.
CACHE_CHUNKS = 400_000
#: Chunks of up to so many symbols keep their agenda in a list instead of a heap.
SHORT = 32
#: Longer chunks are not remembered.
CACHE_LENGTH = 64
#: Characters of chunks that wait for a comparison with the library, and of texts whose chunks are looked up together.
CHECK_LENGTH = 1 << 20
#: Chunks that are looked up, and merged where they are new, at a time.
PORTION = 100_000
#: Widths of the tables in which new chunks are merged, and the rows of one.
WIDTHS = (4, 8, 12, 16, 24, 32, CACHE_LENGTH)
TABLE_ROWS = 20_000
#: Chunks that are joined into one text for the comparison.
CHECK_CHUNKS = 1000
#: An entry of such a table's agenda: the rank of the score, the place of the left symbol, the piece that the pair makes.
RANK, PLACE = 32, 24
NEVER = 1 << 62


class PieceModel:
    """A vocabulary of pieces with merge scores and byte fallback, read through the sentencepiece library."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(k) for k in range(size)]
        self.scores = [lib.get_score(k) for k in range(size)]
        special = [lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) for k in range(size)]
        self.ids = {p: k for k, p in enumerate(self.pieces) if not special[k]}
        self.byte_ids = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if lib.is_byte(k)}
        self.bytes_of = {k: b for b, k in self.byte_ids.items()}
        self.control = {k for k in range(size) if lib.is_control(k)}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary needs byte fallback")
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        #: Where no piece spans the end of a word, no merge crosses it, and words can be encoded one by one.
        self.by_word = not any(inner.search(p) for p in self.ids)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, tuple[int, str, str]] = {}
        #: What entries() remembered before its cache was full; what is met again moves to the cache.
        self.older: dict[str, tuple[int, str, str]] = {}
        self.unchecked: list[tuple[str, str, str]] = []
        self.unchecked_length = 0
        #: A piece's text; None where it is a byte, whose text depends on its neighbours.
        self.plain = [None if k in self.bytes_of else "" if k in self.control else p.replace(SPACE, " ") for k, p in enumerate(self.pieces)]
        self.never = float("-inf")
        self.number = [str(k) for k in range(size)]
        self.pair_table(size)

    def pair_table(self, size: int) -> None:
        """Numbers for symbols, and for each pair of them that is a piece its agenda entry, for merge_many().

        A symbol is a piece or one character; characters that only longer pieces hold are numbered after the pieces.
        """
        if size >= 1 << PLACE:
            raise ValueError("the vocabulary has too many pieces")
        numbers = dict(self.ids)
        for ch in dict.fromkeys("".join(self.ids)):
            numbers.setdefault(ch, size + len(numbers))
        #: The number of whatever pairs with nothing.
        self.alone = max(numbers.values(), default=0) + 1
        self.first = np.full(0x110000, self.alone, np.int64)
        for symbol, k in numbers.items():
            if len(symbol) == 1:
                self.first[ord(symbol)] = k
        ranks = np.unique(-np.array(self.scores), return_inverse=True)[1].tolist()
        pairs = {
            left * (self.alone + 1) + right: ranks[k] << RANK | k
            for p, k in self.ids.items()
            for cut in range(1, len(p))
            if (left := numbers.get(p[:cut])) is not None and (right := numbers.get(p[cut:])) is not None
        }
        # One key more, which no pair has, ends the search.
        keys = np.array([*pairs, (self.alone + 1) ** 2], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_entries = keys[order], np.array([*pairs.values(), NEVER], np.int64)[order]
        self.known = size
        self.numbers, self.texts = pa.array(self.number), pa.array([t or "" for t in self.plain])

    def normalised(self, text: str) -> str:
        """The text as the model sees it: a space in front, spaces as a visible mark. Identity otherwise."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merge_short(self, chunk: str) -> list[int]:
        """As merge(), with the agenda as a plain list of the score of every adjacent pair; faster for a few symbols."""
        ids, scores, never = self.ids, self.scores, self.never
        symbols = list(chunk)
        agenda = [scores[k] if (k := ids.get(a + b)) is not None else never for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) > never:
            at = agenda.index(best)
            symbols[at] = joined = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = scores[k] if (k := ids.get(symbols[at - 1] + joined)) is not None else never
            if at < len(agenda):
                agenda[at] = scores[k] if (k := ids.get(joined + symbols[at + 1])) is not None else never
        return self.ids_of(symbols)

    def offers(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Agenda entries of pairs of numbered symbols; NEVER where a pair is no piece."""
        keys = left * (self.alone + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_entries[at] | place << PLACE, NEVER)

    def merge_many(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """found() by merge() of each of many chunks of up to CACHE_LENGTH symbols, in tables of about equal lengths."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        out: list[tuple[int, str, str]] = [(0, "", "")] * len(chunks)
        for low, width in zip((0, *WIDTHS), WIDTHS):
            fits = np.flatnonzero((lengths > low) & (lengths <= width))
            for lo in range(0, len(fits), TABLE_ROWS):
                rows = fits[lo : lo + TABLE_ROWS]
                places = np.arange(width + 1)[:, None]
                inside = places < lengths[rows]
                signs = codes[np.where(inside, places + starts[rows], 0)]
                symbols = np.where(inside, self.first[signs], self.alone)
                self.merge_table(symbols)
                stays = (inside & (symbols >= 0)).T
                ids, counts, numbers, texts = symbols.T[stays], stays.sum(1), self.numbers, self.texts
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                if len(strange := np.flatnonzero(ids >= self.known)):  # characters that are no piece become bytes
                    chars, which = np.unique(signs.T[stays][strange], return_inverse=True)
                    ids[strange] = self.known + which
                    chars = [chr(c) for c in chars.tolist()]
                    bytes_of = [self.ids_of([c]) for c in chars]
                    numbers = pa.concat_arrays([numbers, pa.array([",".join([self.number[k] for k in x]) for x in bytes_of])])
                    texts = pa.concat_arrays([texts, pa.array(chars)])
                    more = np.array([len(x) - 1 for x in bytes_of])[which]
                    np.add.at(counts, np.searchsorted(offsets, strange, "right") - 1, more)
                joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, a.take(pa.array(ids))), by) for a, by in ((numbers, ","), (texts, ""))]
                for row, found in zip(rows.tolist(), zip(counts.tolist(), *(a.to_numpy(zero_copy_only=False).tolist() for a in joined))):
                    out[row] = found
        return out

    def merge_table(self, symbols: np.ndarray) -> None:
        """Merges the chunks of a table in place: a column holds a chunk's symbols, then ``alone`` in one row at least.

        Every column has its agenda, the entries of all adjacent pairs; a step takes the best one, the leftmost among
        equals, of each column that has any. The merged symbol stands at the left place, -1 at the right one. Symbols are
        a doubly linked list over their places; the last row stands before the first and after the last symbol.
        """
        last, n = len(symbols) - 1, symbols.shape[1]
        places = np.arange(last + 1)[:, None]
        agenda = np.full(symbols.shape, NEVER)
        agenda[:-1] = self.offers(symbols[:-1], symbols[1:], places[:-1])
        before, after = np.repeat((places - 1) % (last + 1), n, 1), np.repeat(np.minimum(places + 1, last), n, 1)
        columns = np.arange(n)
        while len(columns):
            best = agenda.min(0)
            live = best < NEVER
            if live.sum() < 0.8 * len(columns):
                agenda, best, columns = agenda[:, live], best[live], columns[live]
                here, at = np.arange(len(columns)), columns
            else:
                here = np.flatnonzero(live)
                best, at = best[here], columns[here]
            left = best >> PLACE & 0xFF
            right = after[left, at]
            beyond, ahead = after[right, at], before[left, at]
            joined = best & (1 << PLACE) - 1
            symbols[left, at], symbols[right, at] = joined, -1
            after[left, at], before[beyond, at] = beyond, left
            agenda[right, here] = NEVER
            agenda[left, here] = self.offers(joined, symbols[beyond, at], left)
            agenda[ahead, here] = self.offers(symbols[ahead, at], joined, ahead)

    def ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if (k := self.ids.get(s)) is not None:
                out.append(k)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk. Best score first, then leftmost, an adjacent pair that is a piece becomes one symbol.

        Symbols are a doubly linked list over their start positions. An agenda entry is stale, and is skipped, if one
        of its symbols was merged meanwhile, which shows in the total length.
        """
        n = len(chunk)
        if n <= SHORT:
            return self.merge_short(chunk)
        symbols: list[str | None] = list(chunk)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []
        ids, scores = self.ids, self.scores

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (k := ids.get(joined := symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (-scores[k], left, right, len(joined)))

        for at in range(n - 1):
            offer(at, at + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != length:
                continue
            symbols[left], symbols[right] = a + b, None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return self.ids_of([s for s in symbols if s is not None])

    def text_of(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces as UTF-8 (invalid bytes as replacement characters), the mark as a space."""
        try:
            return "".join([self.plain[k] for k in ids])
        except TypeError:  # some are bytes
            pass
        parts: list[str] = []
        run = bytearray()
        for k in ids:
            if (b := self.bytes_of.get(k)) is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if k not in self.control:
                parts.append(self.plain[k])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text[:1] == " " else text

    def found(self, ids: list[int]) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, text)."""
        return len(ids), ",".join([self.number[k] for k in ids]), self.text_of(ids)

    def entry(self, chunk: str) -> tuple[int, str, str]:
        """What is found of a chunk, to be compared with the library, and remembered if the chunk is not long."""
        found = self.found(self.merge(chunk))
        self.unchecked.append((chunk, found[1], found[2]))
        self.unchecked_length += len(chunk)
        if self.unchecked_length >= CHECK_LENGTH:
            self.check()
        if len(chunk) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_CHUNKS:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def entries(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """entry() of every chunk: those that are new and will be remembered are merged together, once each."""
        out: list[tuple[int, str, str]] = []
        for lo in range(0, len(chunks), PORTION):
            part = chunks[lo : lo + PORTION]
            distinct = set(part)
            if len(self.cache) + len(new := distinct.difference(self.cache)) > CACHE_CHUNKS // 2:
                self.older, self.cache, new = self.cache, {}, distinct
            self.cache |= (again := {c: self.older[c] for c in new if c in self.older})
            new = new.difference(again)
            short = [c for c in new if len(c) <= CACHE_LENGTH]
            found = dict(zip(short, self.merge_many(short), strict=True))
            self.cache |= found
            self.unchecked += [(c, x[1], x[2]) for c, x in found.items()]
            self.unchecked_length += sum(map(len, short))
            if self.unchecked_length >= CHECK_LENGTH:
                self.check()
            if len(short) < len(new):
                found |= {c: self.entry(c) for c in new if len(c) > CACHE_LENGTH}
                out += [self.cache.get(c) or found[c] for c in part]
            else:
                out += map(self.cache.__getitem__, part)
        return out

    def check(self) -> None:
        """Compares the chunks encoded since the last call with the library, ids and decoding; a difference raises.

        No merge crosses chunks, so a text's ids are those of its chunks; the library puts the mark in front itself. Many
        chunks are compared as one text: if its ids agree, and each chunk's ids give the chunk, each chunk's ids agree.
        """
        # After a chunk of marks the next one's marks would belong to it, and without words a chunk is a whole text.
        several = [x for x in self.unchecked if self.by_word and x[0][-1] != SPACE]
        alone = [x for x in self.unchecked if not self.by_word or x[0][-1] == SPACE]
        for group in [several[k : k + CHECK_CHUNKS] for k in range(0, len(several), CHECK_CHUNKS)]:
            chunks, ids, texts = zip(*group, strict=True)
            whole = "".join(chunks).replace(SPACE, " ")
            want = self.library.encode(whole[1:])
            right = ",".join([self.number[k] for k in want]) == ",".join(ids) and self.library.decode(want) == whole[1:]
            if not right or any(text != chunk.replace(SPACE, " ") for chunk, text in zip(chunks, texts)):
                alone += group
        for chunk, ids, text in alone:
            # The library has no mark before an empty text, so a mark alone is asked for by its name.
            want = [self.library.piece_to_id(SPACE)] if chunk == SPACE else self.library.encode(chunk[1:].replace(SPACE, " "))
            back = self.library.decode(want)
            if ids != ",".join([self.number[k] for k in want]) or (text[1:] if text[:1] == " " else text) != back:
                raise AssertionError(f"a chunk's ids differ from the library's: {chunk[:200]!r}")
        self.unchecked.clear()
        self.unchecked_length = 0

    def chunks(self, text: str) -> list[str]:
        whole = self.normalised(text)
        return self.chunk.findall(whole) if self.by_word else [whole] if whole else []

    def encoded(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a whole text."""
        get, entry = self.cache.get, self.entry
        return self.joined([get(c) or entry(c) for c in self.chunks(text)])

    def encoded_many(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """encoded() of every text."""
        chunks = [self.chunks(text) for text in texts]
        entries = iter(self.entries([c for found in chunks for c in found]))
        return [self.joined(list(islice(entries, len(found)))) for found in chunks]

    @staticmethod
    def joined(entries: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        decoded = "".join([e[2] for e in entries])
        return sum([e[0] for e in entries]), ",".join([e[1] for e in entries]), decoded[1:] if decoded[:1] == " " else decoded


def encode_batches(batches: Iterator[pa.RecordBatch], model_file: str, check_rows: int | None) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text, encoded. The model goes with the task: a reused worker would hold its memory in other stages."""
    model = PieceModel(model_file)
    for batch in batches:
        counts, hashes, decoded = [], [], []
        texts, length = [], 0
        for row in range(batch.num_rows):
            texts.append(batch.column(1)[row].as_py() or "")
            length += len(texts[-1])
            if length < CHECK_LENGTH and row + 1 < batch.num_rows:
                continue
            for text, (n, ids, back) in zip(texts, model.encoded_many(texts), strict=True):
                if check_rows is None or len(counts) < check_rows:
                    want = model.library.encode(text)
                    if ids != ",".join(map(str, want)) or back != model.library.decode(want):
                        raise AssertionError(f"a text's ids differ from the library's: {text[:200]!r}")
                counts.append(n)
                hashes.append(sha256(ids.encode()).hexdigest())
                decoded.append(sha256(back.encode()).hexdigest())
            texts, length = [], 0
        model.check()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_texts(docs: DataFrame, model_file: str, column: str = "text", check_rows: int | None = 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; no begin or end ids, no sampling.

    All chunks of all texts are checked, ids and decoding, against the sentencepiece library before their batch is given
    on: a chunk is a word with the spaces before it, or the whole text where pieces span words, and a worker checks it
    once while it remembers it. Besides, the first check_rows texts of each Arrow batch are compared as a whole (None: all
    texts), which would show a merge across chunks. A difference raises. A null text is an empty one, with no ids. A null
    doc_id stays null, repeated rows give repeated rows, other columns are left out.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: encode_batches(batches, model_file, check_rows), schema)
