import json

from pyspark.sql import functions as F

from cinderloom import schemas
from cinderloom.streaming import briefs


def test_log_and_briefs_as_they_grow(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"step": 1, "loss": 2.0}\n{"step": 2, "eval_loss": 1.5}\n')
    q = briefs.log_stream(spark, str(log)).writeStream.format("memory").queryName("series").start()
    q.processAllAvailable()
    (log / "b.json").write_text('{"step": 3, "loss": 1.0, "learning_rate": 0.1}\n')
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("series").collect()} == {("loss", 1, 2.0), ("eval_loss", 2, 1.5), ("loss", 3, 1.0), ("learning_rate", 3, 0.1)}

    source, kept = tmp_path / "briefs", str(tmp_path / "kept")
    source.mkdir()
    schema = schemas.struct(description=schemas.S, ordinal=schemas.L)
    for name, texts in (("1", ["A ring spins slowly.", "a ring spins slowly", "dots"]), ("2", ["a ring spins  slowly!", "a comet with a tail"])):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"description": t, "ordinal": i}) for i, t in enumerate(texts)))
        q = briefs.follow(spark, str(source), schema).writeStream.foreachBatch(briefs.accept_batches(kept)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = spark.read.json(kept).select("description", F.col("batch")).collect()
    assert sorted(r.description for r in rows) == ["A ring spins slowly.", "a comet with a tail", "dots"]
