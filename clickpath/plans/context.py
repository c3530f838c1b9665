"""``Funnel``: the six tables plus the views built from them, built once per plan.

Views are plain DataFrames (lazy); an analysis that reads two views built on
the same aggregate reuses one exchange. :meth:`Funnel.materialize` writes the
views to Parquet for workloads that run many analyses over the same data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from clickpath.operators.views import (
    funnel_flags, landing_sessions, product_page_sessions, session_funnel, user_attribution,
)
from clickpath.spec import DEFAULT_SPEC, FunnelSpec


class Funnel:
    def __init__(self, tables: dict, spec: FunnelSpec = DEFAULT_SPEC, touch: str = "first_order"):
        self.tables = tables
        self.spec = spec
        self.touch = touch

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @cached_property
    def flags(self) -> DataFrame:
        """One row per session with pageviews: session_start, landing, product label, flags."""
        return funnel_flags(self.tables["pageviews"], self.spec)

    @cached_property
    def product_view(self) -> DataFrame:
        return product_page_sessions(self.tables["pageviews"], self.spec, flags=self.flags)

    @cached_property
    def landing(self) -> DataFrame:
        return landing_sessions(self.tables["pageviews"], self.spec, flags=self.flags)

    @cached_property
    def session_funnel(self) -> DataFrame:
        t = self.tables
        return session_funnel(t["sessions"], self.landing, t["orders"], t["order_items"])

    def session_funnel_with(self, *extra_cols: str) -> DataFrame:
        """The session funnel plus further session columns."""
        t = self.tables
        return session_funnel(t["sessions"], self.landing, t["orders"], t["order_items"], extra_cols=extra_cols)

    @cached_property
    def attribution(self) -> DataFrame:
        t = self.tables
        return user_attribution(t["sessions"], t["orders"], touch=self.touch, with_times=True)

    def materialize(self, path: str | None = None, mode: str = "overwrite") -> "Funnel":
        """Write the views once (Parquet) and return a Funnel that reads them back.

        Without ``path`` the views go under the session's ``spark.checkpoint.dir``
        (a shared folder on a cluster), so the written tables survive the loss
        of any executor and cut the lineage of every report built on them.
        """
        spark = self.tables["sessions"].sparkSession
        if path is None:
            import uuid

            from clickpath.session import ensure_checkpoint_dir
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clickpath-views-{uuid.uuid4().hex}"
        out = Funnel(self.tables, self.spec, self.touch)
        from pyspark.sql import functions as F
        for name in ("flags", "session_funnel", "attribution"):
            df = getattr(self, name)
            w = df.write.mode(mode)
            if name == "flags":
                # partitioned by the month the session started: a month of new data rewrites
                # one partition (with dynamic partition overwrite), reports prune by month
                df = df.withColumn("session_month", F.trunc("session_start", "MM"))
                w = df.write.mode(mode).partitionBy("session_month")
            w.parquet(f"{path.rstrip('/')}/{name}")
            back = spark.read.parquet(f"{path.rstrip('/')}/{name}")
            out.__dict__[name] = back.drop("session_month") if name == "flags" else back
        return out

    def materialize_tables(self, prefix: str = "clickpath", buckets: int = 64,
                           database: str | None = None) -> "Funnel":
        """Write the views as catalog tables bucketed (and sorted) by their join key.

        Session-grain tables are bucketed by ``website_session_id`` and the
        attribution table by ``user_id``, all with the same bucket count, so a
        join between two session-grain tables reads matching buckets with no
        shuffle at all. Pick ``buckets`` so one bucket file is ~128-512 MB.
        """
        spark = self.tables["sessions"].sparkSession
        out = Funnel(self.tables, self.spec, self.touch)
        keys = {"flags": "website_session_id", "session_funnel": "website_session_id", "attribution": "user_id"}
        for name, key in keys.items():
            table = f"{database + '.' if database else ''}{prefix}_{name}"
            (getattr(self, name).write.mode("overwrite").format("parquet")
             .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
            out.__dict__[name] = spark.table(table)
        return out
