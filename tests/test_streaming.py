"""The ledger stream stores each message once, over batches and restarts."""

import json

from marlstone.streaming import ledger

H = "a" * 64


def _line(i, evidence, verdict="confirmed", **more):
    return json.dumps({"outcome_id": i, "report_id": H, "evidence_id": evidence, "verdict": verdict, "received_at": f"2025-01-0{1 + i % 5}T00:00:00Z", **more})


def test_stream_stores_messages_once(spark, tmp_path):
    source, target, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    source.mkdir()
    (source / "1.json").write_text("\n".join([_line(1, "b" * 64), _line(2, "B" * 64), "{broken", _line(3, "c" * 64, "maybe"), _line(4, "c" * 64, review_ms=-1)]))

    def run():
        q = ledger.valid(ledger.read_lines(spark, str(source))).writeStream.option("checkpointLocation", str(marks)).trigger(availableNow=True).foreachBatch(ledger.store_once(str(target))).start()
        q.awaitTermination(120)

    run()
    (source / "2.json").write_text("\n".join([_line(5, "sha256:" + "b" * 64), _line(6, "d" * 64), _line(7, None)]))
    run()
    assert sorted(r.outcome_id for r in spark.read.parquet(str(target)).collect()) == [1, 6, 7]


def test_windows(spark, tmp_path):
    (tmp_path / "1.json").write_text("\n".join([_line(1, "b" * 64), _line(6, "d" * 64, "refuted"), _line(2, "b" * 64)]))
    q = ledger.windowed_outcomes(ledger.valid(ledger.read_lines(spark, str(tmp_path)))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.outcomes for r in spark.sql("SELECT * FROM windows").collect()) == 3
