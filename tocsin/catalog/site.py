"""The given ``events`` table read as a sensor journal, and its vocabulary."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import Sign, Vocabulary
from ..functions.timebase import HOUR, MINUTE, us_of
from ..operators.settle import settle
from ..plans import features as X
from ..plans import labels as L

VOC = Vocabulary(
    triggers=[
        ("fire", Sign(("smoke",))),
        ("fire", Sign(("temperature",), lo=40, hi=80)),
        ("gas", Sign(("gas",), lo=5, hi=15)),
        ("equipment", Sign(("pump",))),
        ("sensor", Sign(("temperature",), ("faulted",))),
        ("sensor", Sign(("temperature",), above=80)),
        ("sensor", Sign(("gas",), above=15)),
    ],
    counters=[
        ("smoke", Sign(("smoke",), ("smoke_detected",))),
        ("pump_fault", Sign(("pump",), ("faulted",))),
        ("temp_fault", Sign(("temperature",), ("faulted",))),
        ("door", Sign(("door",), ("open",))),
        ("motion", Sign(("motion",), ("detected",))),
        ("arm", Sign(("guard",), ("armed",))),
        ("disarm", Sign(("guard",), ("disarmed",))),
    ],
    armed=Sign(("guard",), ("armed",)),
    disarmed=Sign(("guard",), ("disarmed",)),
    openings=(Sign(("door",), ("open",)),),
    motion=(Sign(("motion",), ("detected",)),),
    doors=(Sign(("door",), ("open",)),),
    visit_motion=(Sign(("motion",), ("detected",)),),
    mass=Sign(("smoke",)),
    flooded=Sign(("temperature",), ("faulted",)),
    power_back=(Sign(("pump",), ("faulted",)),),
    power_lost=(Sign(("pump",), ("faulted",)),),
    gas=Sign(("gas",), lo=0, hi=15),
    temperature=Sign(("temperature",), lo=-40, hi=80),
    undefined=("faulted",),
    link_skip=("guard",),
)

# the given journal is thin: thresholds that keep every operator non-empty
PARAMS = L.LabelParams(
    mass_channels=2,
    mass_span=2 * HOUR,
    power_before_flood=60 * MINUTE,
    primary=12 * HOUR,
    mass_code="mass",
    power_code="power",
    works_code="works",
    break_in="open while armed",
)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, kind, value = F.col("user_id"), F.col("event_type"), F.col("value")
    stype = (
        F.when(kind == "purchase", "guard")
        .when(kind == "signup", "door")
        .when(kind == "click", "motion")
        .when(kind == "error", F.when(user % 3 == 0, "smoke").when(user % 3 == 1, "pump").otherwise("temperature"))
        .otherwise(F.when(user % 2 == 0, "temperature").otherwise("gas"))
    )
    state = (
        F.when(kind == "purchase", F.when(value >= 35, "armed").otherwise("disarmed"))
        .when(kind == "signup", "open")
        .when(kind == "click", "detected")
        .when(kind == "error", F.when(user % 3 == 0, "smoke_detected").otherwise("faulted"))
    )
    num = F.when(kind == "view", F.when(user % 2 == 0, value - 20).otherwise(value / 10))
    return e.select(
        "event_id",
        (user % 12).alias("object_id"),
        (100 + (user % 12) % 4).alias("collector_id"),
        user.alias("channel_id"),
        us_of("ts").alias("us"),
        stype.alias("stype"),
        state.alias("state"),
        num.alias("num"),
    )


STYPES = ["door", "gas", "guard", "motion", "pump", "smoke", "temperature"]

SCORED = ("fire", "gas", "equipment", "sensor")
SPLIT_H = 300
SHARE = 0.2
BY = ["run", "type", "split"]

_STAGES: dict[tuple[str, str], "Site"] = {}


def site(spark: SparkSession, sf_dir: str) -> "Site":
    """Stages are written once per session and data folder, as a pipeline
    writes its tables; later queries read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGES:
        _STAGES[key] = Site(spark, sf_dir)
    return _STAGES[key]


class Site:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def journal(self) -> DataFrame:
        """Written once: every rule over derived columns would hold their whole
        expressions again, several times a row, in each of a dozen scans."""
        return settle(journal(self.spark, self.dir))

    @cached_property
    def objects(self) -> DataFrame:
        return settle(self.journal.select("object_id", "collector_id").distinct())

    @cached_property
    def channels(self) -> DataFrame:
        return settle(self.journal.select("channel_id", "stype", "object_id", "collector_id").distinct())

    @cached_property
    def guard(self) -> DataFrame:
        return settle(L.guard_timeline(self.journal, VOC))

    @cached_property
    def openings(self) -> DataFrame:
        # an as-of join reads its sides twice, so joins on joins are settled in between
        armed = settle(L.armed_openings(self.journal, self.guard, VOC))
        moved = settle(L.opening_then_motion(armed, self.journal, VOC, PARAMS))
        return settle(L.with_arrival(moved, self.guard, PARAMS))

    @cached_property
    def triggers(self) -> DataFrame:
        own = L.journal_triggers(self.journal, VOC)
        return settle(own.unionByName(L.intrusion_triggers(self.openings, PARAMS)))

    @cached_property
    def noise(self) -> DataFrame:
        mass = L.noise_mass(self.triggers, VOC, PARAMS)
        return settle(mass.unionByName(L.noise_power_flood(self.triggers, VOC, PARAMS)))

    @cached_property
    def visits(self) -> DataFrame:
        return settle(L.visits(self.journal, self.guard, VOC, PARAMS))

    @cached_property
    def marked(self) -> DataFrame:
        return settle(L.mark_noise(self.triggers, self.noise))

    @cached_property
    def episodes(self) -> DataFrame:
        return settle(L.episodes(self.marked, self.visits, PARAMS))

    @cached_property
    def stages(self) -> X.Stages:
        return X.Stages(
            self.journal, self.objects, self.guard, self.openings, self.triggers, self.visits, self.episodes
        )

    @cached_property
    def bounds(self) -> tuple[int, int]:
        return X.hour_bounds(self.journal)

    @cached_property
    def grid(self) -> DataFrame:
        return settle(X.hour_grid(self.stages, VOC, PARAMS, *self.bounds))

    # hours of a data loss: one night
    @cached_property
    def holes(self) -> list[tuple[int, int]]:
        lo, _ = self.bounds
        return [(lo + 400, lo + 406)]

    @cached_property
    def mart(self) -> DataFrame:
        return settle(
            X.mart_assemble(self.grid, self.episodes, self.channels, STYPES, VOC, self.holes, self.bounds[1])
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Two model-free scores per type: how busy the type was, how recent."""
        lo = self.bounds[0]
        rows = []
        for t in SCORED:
            busy = (F.col(f"trig_{t}_24h") * 64 + F.col(f"onset_{t}_168h") * 16 + F.col("events_24h")) / 4096
            for run, p in (("busy", busy), ("recency", (-F.col(f"since_{t}")).cast("double"))):
                rows.append(
                    F.struct(F.lit(run).alias("run"), F.lit(t).alias("type"), p.alias("p"), F.col(f"next_{t}").alias("next"))
                )
        split = F.when(F.col("h") < lo + SPLIT_H, "val").otherwise("test")
        return settle(
            self.mart.select("object_id", "collector_id", "h", split.alias("split"), F.explode(F.array(*rows)).alias("s"))
            .select("s.*", "split", "object_id", "collector_id", "h")
        )

    def thresholds(self, share: float, by=("run", "type", "split")) -> DataFrame:
        from ..plans.metrics import threshold_for_share

        return threshold_for_share(self.scores, list(by), [share])

    @cached_property
    def alarms(self) -> DataFrame:
        """Alarm hours at the working share of each run, type and split."""
        from ..plans.metrics import alarm_rows

        return settle(alarm_rows(self.scores, self.thresholds(SHARE), BY))

    @cached_property
    def seen(self) -> DataFrame:
        from ..plans.metrics import seen_episodes

        return settle(seen_episodes(self.scores, BY))
