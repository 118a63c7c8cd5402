"""A message that comes again with its row id is stored once."""

import datetime as dt
import json

from marlstone.operators import delivery
from marlstone.streaming import ledger

MESSAGE = (["report_id", "evidence_id"], "timestamp", "outcome_id", "received_at")
OUT = "outcome_id long, report_id string, evidence_id string, timestamp string, received_at timestamp, note string"
DAY = dt.datetime(2025, 1, 1)


def test_admit_keeps_one_of_exact_repeats(spark):
    row, other = (7, "a", "b", None, DAY, "x"), (7, "a", "b", None, DAY, "y")
    rows = [row, row, other, (8, "a", "b", None, DAY, "x"), (9, None, "b", None, DAY, "x"), (9, None, "b", None, DAY, "x")]
    batch = spark.createDataFrame(rows, OUT)
    got = delivery.admit(batch.limit(0), batch, *MESSAGE)
    assert sorted(r.outcome_id for r in got.collect()) == [7, 9, 9] and got.columns == batch.columns


def test_stream_stores_a_line_repeated_in_one_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = json.dumps({"outcome_id": 1, "report_id": "a", "evidence_id": "b", "timestamp": "2025-01-01T00:00:00Z", "verdict": "confirmed", "received_at": "2025-01-01T00:00:00"})
    (tmp_path / "in/x.json").write_text(f"{line}\n{line}\n")
    target = f"{tmp_path}/out"
    records = ledger.valid(ledger.read_lines(spark, f"{tmp_path}/in"))
    records.writeStream.foreachBatch(ledger.store_once(target)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    assert [r.outcome_id for r in spark.read.parquet(target).collect()] == [1]
