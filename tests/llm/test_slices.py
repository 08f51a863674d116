"""Slices that Python functions get: cut by the rows' own sizes; memories given up at the end."""

import numpy as np
import pyarrow as pa

from tabcal.llm.common import _slices, append_columns
from tabcal.llm.sentence_pieces import MODEL, Pieces


def test_slices_follow_the_rows_sizes():
    texts = ["a" * 10] * 50 + ["b" * 100_000] + ["c" * 10] * 50 + ["d" * 90_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k0", "i0"])
    cuts = list(_slices(batch, 1, 1_000))
    assert sum(n for _, n in cuts) == len(texts) and [a for a, _ in cuts] == list(np.cumsum([0] + [n for _, n in cuts])[:-1])
    sizes = [sum(len(t or "") for t in texts[a:a + n]) for a, n in cuts]
    assert all(size <= 1_000 or n == 1 for size, (_, n) in zip(sizes, cuts, strict=True))
    nested = pa.RecordBatch.from_arrays([pa.array([[{"x": "y" * 500}], None, [{"x": "z"}] * 3, [{"x": "y" * 5_000}], []])], ["i0"])
    assert sum(n for _, n in _slices(nested, 0, 600)) == 5 and len(list(_slices(nested, 0, 600))) > 2
    assert list(_slices(batch.slice(0, 0), 1, 10)) == []


def test_close_is_called_at_the_end_of_a_task(spark, tmp_path):
    path = str(tmp_path)

    def start():
        call = lambda texts: ([len(t or "") for t in texts],)
        call.close = lambda: open(f"{path}/{id(call)}", "w").close()
        return call

    df = spark.createDataFrame([("a",), (None,), ("abc",)], "text string").coalesce(1)
    assert sorted(r["n"] for r in append_columns(df, ["text"], "n int", start).collect()) == [0, 1, 3]
    assert len(list(tmp_path.iterdir())) == 1


def test_small_memories_change_no_ids(monkeypatch):
    import tabcal.llm.sentence_pieces as module

    with open(MODEL, "rb") as f:
        model = f.read()
    texts = [f"the  {i % 7} cat{i % 11} sat on word{i} ünïcode▁x " * 3 for i in range(60)] + [None, "", " ", "plain words here"]
    whole = Pieces.load(model).encode(texts)
    monkeypatch.setattr(module, "REMEMBERED_BYTES", 3_000)
    small = Pieces.load(model)
    assert [x for i in range(0, len(texts), 5) for x in small.encode(texts[i:i + 5])] == whole
    small.forget()
    assert not small.known and not small._apart and small.encode(texts) == whole
