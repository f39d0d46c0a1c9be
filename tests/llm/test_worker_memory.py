"""What a Python worker holds while it packs."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

from platen.llm import packing
from platen.llm.common import batches_of
from platen.llm.queries import word_tokenizer

ALONE = """
import os, sys
import numpy as np
from platen.llm import packing
np.ones((64, 64)) @ np.ones((64, 64))
before = len(os.listdir("/proc/self/task"))
encoder = packing.WordTokenizer.kept(sys.argv[1])
data = np.frombuffer(" ".join(f"word{i}x" for i in range(20_000)).encode(), np.uint8)
ids, lengths = encoder.encode(packing.Pieces(data, np.array([0, len(data)])))
assert len(ids) == lengths.sum() > 20_000
print(len(os.listdir("/proc/self/task")) - before)
"""


@pytest.mark.skipif(not os.path.isdir("/proc/self/task"), reason="threads are counted in /proc")
def test_the_tokenizer_of_a_worker_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    got = subprocess.run([sys.executable, "-c", ALONE, word_tokenizer()], env=env, capture_output=True, text=True, check=True)
    assert got.stdout.strip() == "0"


def test_texts_are_sent_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 9000, 1, 1)
    with batches_of(spark, packing.BATCH):
        assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= packing.BATCH
    assert spark.conf.get(name) == before

    made = packing.cut
    monkeypatch.setattr(packing, "cut", lambda df: seen.append(int(spark.conf.get(name))) or made(df))
    packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), word_tokenizer())
    assert seen == [packing.BATCH] and spark.conf.get(name) == before
