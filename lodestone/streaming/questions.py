"""A stream of questions: answers come as ordered tokens, each question once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def answered(engine: Engine, out: str, kind: str = "long") -> DataFrame:
    """(query_id, seq, text, done, batch) of all finished batches; ``kind`` is the
    type of the ids."""
    columns = f"query_id {kind}, seq int, text string, done boolean"
    done = [f"{out}/{n}" for n in engine.store.names(out) if n.startswith("batch=") and "_SUCCESS" in engine.store.names(f"{out}/{n}")]
    if done:
        return engine.spark.read.schema(columns).option("basePath", out).parquet(*done)
    return engine.spark.createDataFrame([], f"{columns}, batch int")


def answer(engine: Engine, questions: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream: questions (query_id, text) → tokens (query_id, seq,
    text, done) under ``out``, a folder a batch.

    A batch that is run again after a failure writes its folder again, so no
    token is there twice; a question whose id another batch has answered is left
    out, as is a second one of the same batch. Tokens of a question are numbered
    in their order, the last one is marked."""
    kind = questions.schema["query_id"].dataType.simpleString()

    def load(batch: DataFrame, number: int) -> None:
        before = answered(engine, out, kind).where(F.col("batch") != number).select("query_id").distinct()
        fresh = batch.where("text IS NOT NULL AND text <> ''").dropDuplicates(["query_id"]).join(before, "query_id", "left_anti")
        _, _, asked = engine.prompts(fresh, stream=True)
        engine.generate(asked).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
