import pyarrow as pa

from rarespark.llm.rows import few_rows


def test_few_rows_at_a_time():
    batches = [pa.record_batch({"x": list(range(low, high))}) for low, high in ((0, 600), (600, 601), (601, 601), (601, 1200))]
    parts = list(few_rows(iter(batches)))
    assert max(p.num_rows for p in parts) <= 256
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1200))
