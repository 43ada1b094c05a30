"""Python workers hold a slice of a batch at a time, however many rows a batch has."""

import pyarrow as pa

from cadenza.llm import common


def test_portions_are_consecutive_and_bounded():
    texts = ["ab" * 50, None, "", "x" * 1000, "é" * 30, "y" * 80]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    parts = list(common.portions(batch, 1, 150))
    assert [r for p in parts for r in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 150 for p in parts)


def test_repeats_yields_small_batches():
    from cadenza.llm import repeats

    class Table:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([f"{k} " + "some words " * 60 for k in range(3000)])], names=["id", "text"])
    seen = []
    cut, own = repeats._cut, lambda raws, gram: (seen.append(sum(map(len, raws))), cut(raws, gram))[1]
    repeats._cut = own
    try:
        rows = sum(b.num_rows for b in repeats._placed(Table())(iter([batch])))
    finally:
        repeats._cut = cut
    assert rows > 3000 and max(seen) <= repeats.SLICE


def test_bpe_forgets_words_beyond_its_cache():
    from cadenza.llm import bpe
    from cadenza.llm.queries import vocabulary

    coder = bpe.MergeReplay(bpe.parse_ranks(vocabulary()[0]), vocabulary()[1])
    texts = [[" ".join(f"w{chr(97 + k)}{chr(97 + n % 26)}{chr(97 + n // 26)}x" for n in range(500))] for k in range(8)]
    free = [list(coder.encode_batch(t)) for t in texts]
    coder.forget()
    assert [list(coder.encode_batch(t, 600)) for t in texts] == free
    assert len(coder.spaced) + len(coder.ids) < 3000
