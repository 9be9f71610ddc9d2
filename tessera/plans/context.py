"""Per-session reuse of derived dimension tables.

The station → county map, the prepared boundaries and the county-level
profiles are small (one row per station or county) but are derived from
full scans of trips and spending.  Several registered queries need them,
so a ``Context`` computes each once per (session, input folder) and cuts
its lineage with a reliable ``checkpoint()`` into ``spark.checkpoint.dir``
(a shared folder on a cluster, so the result survives executor loss and
later plans stay small — planning a long lineage again and again costs
more than the data work).  The join behind the trips is written once, as
stations and county statistics read it several times; what is derived from
it on the level of trips stays a lazy plan that joins the broadcast
station map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import features, spatial, spending
from tessera.session import cut_lineage
from tessera.sources import views

TEMPORAL = ("peak_hour_ratio", "weekend_ratio", "night_trips_ratio", "summer_trips_ratio", "winter_trips_ratio",
            "seasonal_variation")
_CACHE: dict[tuple, tuple] = {}


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input folder's files: a rewritten folder gets a new context."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._memo: dict[str, DataFrame] = {}

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = cut_lineage(build())
        return self._memo[name]

    # ---- inputs (lazy views)
    def trips(self) -> DataFrame:
        return views.trips(self.spark, self.sf_dir)

    def boundaries(self) -> DataFrame:
        return views.boundaries(self.spark, self.sf_dir)

    def spending(self) -> DataFrame:
        """County × month × category spending: small, but derived from a
        four-way join of the largest tables, so it is materialized once."""
        return self._keep("spending", lambda: views.spending(self.spark, self.sf_dir))

    def population(self) -> DataFrame:
        return self._keep("population", lambda: views.population(self.spark, self.sf_dir))

    # ---- derived dimensions (persisted, small)
    def prepared(self) -> DataFrame:
        return self._keep("prepared", lambda: spatial.prepare_boundaries(self.boundaries()))

    def stations(self) -> DataFrame:
        return self._keep("stations", lambda: spatial.extract_stations(self.joined_trips()))

    def assigned(self) -> DataFrame:
        return self._keep("assigned", lambda: spatial.assign_stations(self.stations(), self.prepared()))

    def station_map(self) -> DataFrame:
        return self._keep("station_map", lambda: spatial.station_county_map(self.assigned()))

    # ---- trip level
    def joined_trips(self) -> DataFrame:
        """The trips over their join written once: each further pass is a scan of the columns it needs."""
        return views.as_trips(self._keep("trip_rows", lambda: views.trip_rows(self.spark, self.sf_dir)))

    def enriched_trips(self) -> DataFrame:
        return spatial.add_trip_metrics(spatial.add_county_info(self.joined_trips(), self.station_map()))

    # ---- county level (persisted, small)
    def county_statistics(self) -> DataFrame:
        """H01 and H06 from one pass over the trips."""
        return self._keep("county_statistics", lambda: spatial.county_aggregation(
            self.enriched_trips(), features.temporal_aggregates()))

    def temporal_patterns(self) -> DataFrame:
        return self.county_statistics().select("county_fips", *TEMPORAL)

    def county_mobility(self) -> DataFrame:
        return self._keep("county_mobility", lambda: spatial.add_county_metadata(
            self.county_statistics().drop(*TEMPORAL), self.prepared()))

    def mobility_features(self) -> DataFrame:
        return self._keep("mobility_features", lambda: features.create_mobility_features(
            self.county_mobility(), None, self.population(), self.temporal_patterns()))

    def spending_features(self) -> DataFrame:
        return self._keep("spending_features", lambda: spending.create_spending_features(
            self.spending(), self.population()))


def context(spark: SparkSession, sf_dir: str) -> Context:
    key, now = (spark.sparkContext.applicationId, sf_dir.rstrip("/")), _fingerprint(spark, sf_dir)
    if key not in _CACHE or _CACHE[key][0] != now:
        _CACHE[key] = (now, Context(spark, sf_dir))
    return _CACHE[key][1]
