"""Looking a row's words up needs no table of all frequent words, whose number grows with the input."""

import subprocess
import sys

SCRIPT = """
import pyarrow as pa
from pointweave.llm.collocations import _Sent
n = 500_000
sent = _Sent(pa.table({"id": pa.array(range(n), pa.int32()), "lang": ["en"] * n, "word": [f"w{k}" for k in range(n)]}))
words = pa.array(["none", "w7", "w499999", "w0", "x"])
pool = pa.default_memory_pool()
held, before = pool.bytes_allocated(), pool.max_memory()
fill = pa.allocate_buffer(max(0, before - held))
place, ids = sent.words("en", words)
print(place.tolist(), ids.tolist(), pool.max_memory() - before < 8 << 20)
"""


def test_the_words_of_a_row_are_hashed():
    out = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, check=True).stdout
    assert out.strip() == "[1, 2, 3] [7, 499999, 0] True"
