"""Requests against an engine: predictions, mutagenesis and interpretation as functions that return plain values.

A request runs in a job group of its own, which is cancelled when its time is up; whatever goes wrong comes back as a
structured error. Requests are for a few sequences; tables go through the operators.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import sequence as sq
from codonlake.functions import vectors as vec
from codonlake.operators import mutagenesis as mu
from codonlake.operators import scoring
from codonlake.sources.files import from_memory

MOST_SEQUENCES = 1000
MOST_POSITIONS = 5


class Service:
    def __init__(self, spark: SparkSession, models: dict[str, Callable[[DataFrame], DataFrame]] | None = None, timeout: float = 30.0):
        """``models``: functions that add ``logits`` to a table with ``sequence``. The native scorer is always there."""
        if not 1 <= timeout <= 300:
            raise ValueError("timeout must be 1 to 300 seconds")
        self.spark, self.timeout = spark, timeout
        self.models = {"native": native_logits} | (models or {})

    def _run(self, work: Callable[[], Any]) -> dict[str, Any]:
        group, out = uuid.uuid4().hex, {}

        def target() -> None:
            try:
                self.spark.sparkContext.setJobGroup(group, "request", interruptOnCancel=True)
                out["value"] = work()
            except Exception as e:
                out["error"] = {"kind": type(e).__name__, "message": str(e).splitlines()[0][:500]}

        t = threading.Thread(target=target, daemon=True)
        t.start()
        t.join(self.timeout)
        if t.is_alive():
            self.spark.sparkContext.cancelJobGroup(group)
            return {"success": False, "error": {"kind": "Timeout", "message": f"no result within {self.timeout} seconds"}}
        return {"success": "error" not in out} | out

    def _rows(self, sequences: list[str]) -> DataFrame:
        if not sequences or len(sequences) > MOST_SEQUENCES:
            raise ValueError(f"a request takes 1 to {MOST_SEQUENCES} sequences")
        return self.spark.createDataFrame(list(enumerate(sequences)), "row_id bigint, sequence string")

    def _model(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self.models:
            raise ValueError(f"no model named {name}")
        return self.models[name]

    def predict(self, sequences: str | list[str], model: str = "native", threshold: float = 0.5) -> dict[str, Any]:
        """Probability and label of each sequence; a sequence that is no DNA carries an error."""
        many = [sequences] if isinstance(sequences, str) else list(sequences)

        def work() -> list[dict]:
            rows = self._model(model)(self._rows(many)).withColumn("p", scoring.binary_prediction(F.col("logits"), threshold))
            bad = ~sq.is_dna(F.col("sequence"))
            got = rows.select("row_id", F.when(bad, None).otherwise(F.col("p.prob")).alias("prob"), F.when(bad, None).otherwise(F.col("p.pred")).alias("pred"), F.when(bad, "not a DNA sequence").alias("error"))
            return [r.asDict() for r in got.orderBy("row_id").collect()]

        return self._run(work)

    def predict_models(self, sequence: str, models: list[str], threshold: float = 0.5) -> dict[str, Any]:
        """The prediction of each model; one that fails doesn't fail the others."""
        results = {m: self.predict(sequence, m, threshold) for m in models}
        good = sum(r["success"] for r in results.values())
        return {"success": good > 0, "results": results, "succeeded": good, "failed": len(results) - good}

    def mutagenesis(self, sequence: str, positions: list[int] | None = None) -> dict[str, Any]:
        """Effects of the substitutions at all or the named positions, and their means."""
        def work() -> dict:
            eff = mu.effects(self._rows([sequence]), "row_id", "sequence")
            if positions is not None:
                eff = eff.where(F.col("pos").isin(positions))
            rows = [r.asDict() for r in eff.orderBy("pos", "alt").collect()]
            n = len(rows) or 1
            return {"effects": rows, "mean_score": sum(r["score"] or 0.0 for r in rows) / n, "mean_diff": sum(r["diff"] for r in rows) / n}

        return self._run(work)

    def combinations(self, sequence: str, positions: list[int]) -> dict[str, Any]:
        """The probability of every combination of bases at up to MOST_POSITIONS positions."""
        def work() -> list[dict]:
            if not 1 <= len(set(positions)) <= MOST_POSITIONS or min(positions) < 0 or max(positions) >= len(sequence):
                raise ValueError(f"name 1 to {MOST_POSITIONS} positions of the sequence")
            df = self._rows([sequence]).select("sequence")
            for p in sorted(set(positions)):
                df = df.withColumn("b", F.explode(F.array(*[F.lit(b) for b in "ACGT"])))
                df = df.withColumn("sequence", F.concat(F.substring("sequence", 1, p), "b", F.substring("sequence", p + 2, len(sequence)))).drop("b")
            scored = df.select("sequence", scoring.probability(scoring.weight_sum(F.col("sequence"))).alias("prob"))
            return [r.asDict() for r in scored.orderBy(F.desc("prob"), "sequence").collect()]

        return self._run(work)

    def interpret(self, sequence: str, width: int = 1) -> dict[str, Any]:
        """Attribution of each position by occlusion, and scaled to 0..1."""
        def work() -> dict:
            rows = mu.occlusion(self._rows([sequence]), "row_id", "sequence", width).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "attribution"))).alias("a"))
            r = rows.select(F.col("a.attribution").alias("raw")).select("raw", vec.min_max(F.col("raw")).alias("scaled")).first()
            return {"attribution": r["raw"], "scaled": r["scaled"]} if r else {"attribution": [], "scaled": []}

        return self._run(work)

    def list_models(self) -> list[str]:
        return sorted(self.models)

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "models": len(self.models), "spark": self.spark.version}


def native_logits(df: DataFrame) -> DataFrame:
    s = scoring.weight_sum(F.col("sequence")) / scoring.SCALE
    return df.withColumn("logits", F.array(F.lit(0.0), s))


def load(spark: SparkSession, sequences: str | list[str]) -> DataFrame:
    """Sequences from memory or a file, for requests."""
    return from_memory(spark, sequences)
