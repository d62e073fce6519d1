from __future__ import annotations

import pyarrow as pa

from basketlens.llm.tables import ARROW_BYTES, ARROW_ROWS, prepared


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = prepared(spark).range(0, 2000, 1, 1).selectExpr("repeat('words ', 4000) as text")
    found = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(row.n for row in found) == 2000 and max(row.n for row in found) <= ARROW_ROWS
    assert max(row.bytes for row in found) < 2 * ARROW_BYTES
