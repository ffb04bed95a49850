"""Rule and device configuration from one JSON file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.schemas import CONFIG

# Newest samples that a ">" rule looks at if its count is -1 (fixed value).
ABOVE_SAMPLES = 10


@dataclass(frozen=True)
class EvalRule:
    """One line of the evaluation table; ``sign`` is ``">"`` or ``"avg<"``.

    ``count`` is how many of the newest samples the rule looks at; -1 in a ``>`` rule stands for
    ``ABOVE_SAMPLES``.
    """

    event: str
    sign: str
    count: int
    threshold: int

    @property
    def samples(self) -> int:
        if self.count < 1 and not (self.sign == ">" and self.count == -1):
            raise ValueError(f"a rule on {self.event} cannot look at {self.count} samples")
        return ABOVE_SAMPLES if self.count == -1 else self.count


@dataclass(frozen=True)
class Fence:
    """A circle on the map; the radius is text with a unit, as in ``"9000 ft"``."""

    latitude: float
    longitude: float
    radius: str


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration document as one row."""
    return spark.read.schema(CONFIG).json(path, multiLine=True)


def devices(config: DataFrame) -> DataFrame:
    return config.select(F.explode("device_ids").alias("device_id"))


def series(config: DataFrame) -> DataFrame:
    """The catalogue: each device with each event type."""
    return config.select(F.explode("device_ids").alias("device_id"), "event_types").select(
        "device_id", F.explode("event_types").alias("event_type")
    )


def eval_rules(config: DataFrame) -> list[EvalRule]:
    """The rule rows. The configuration is one document, so this reads a few lines."""
    rows = config.select(F.explode("evaluation").alias("r")).select("r.*").collect()
    return [EvalRule(r["event"], r["sign"], r["count"], r["threshold"]) for r in rows]


def patterns(config: DataFrame) -> list[list[str]]:
    rows = config.select(F.explode("sequence").alias("p")).collect()
    return [[step.strip() for step in r["p"].split(",")] for r in rows]


def fence(config: DataFrame, name: str = "detection") -> Fence:
    row = config.select(f"{name}.*").first()
    return Fence(float(row["latitude"]), float(row["longitude"]), row["radius"])


def rule_column(rules: list[EvalRule], event_type: Column) -> Column:
    """For each event, the array of rules on its type: the rule table as a literal."""
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_id"),
                F.lit(r.event).alias("event"),
                F.lit(r.sign).alias("sign"),
                F.lit(r.samples).alias("samples"),
                F.lit(r.threshold).alias("threshold"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return F.filter(table, lambda r: r["event"] == event_type)
