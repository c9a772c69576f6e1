"""Long texts are scored a slice at a time."""

import pyarrow as pa

from pagemill.operators import scoring


def test_batches_of_long_texts_are_cut_and_no_row_is_lost():
    """F14."""
    long = pa.RecordBatch.from_pydict({"n": list(range(100)), "text": ["x" * 1000] * 100})
    none = long.slice(0, 0)
    got = list(scoring._slices(iter([long, none, long.slice(0, 3)]), size=10_000))
    assert [n for b in got for n in b.column(0).to_pylist()] == [*range(100), 0, 1, 2]
    assert max(b.nbytes for b in got) <= 10_000
