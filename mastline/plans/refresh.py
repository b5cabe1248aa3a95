"""Keyed refresh: recompute the customers a change touches, table by table.

A change that touches few customers is named in the scans: tables in the order of the customer
(``publish_clustered``, and the derived tables themselves) are then read by the page. A larger
one is joined.
"""

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mastline.functions.usage import seconds_between
from mastline.operators import features as f
from mastline.operators.changes import FEATURE_OF, affected_by_feature
from mastline.operators.joins import (
    BROADCAST_ROWS,
    keep_keys,
    rows_of,
    sorted_if_many,
    union_all,
)
from mastline.operators.tags import customer_tags
from mastline.plans.base import BaseTables, Change
from mastline.plans.inputs import InputLog, compared, identities
from mastline.sources.store import Commit, CommitLog, KeyedTable, range_bounds, write_counted

_KEY = "customer_id"
CHILDREN = ["subscription_features", "billing_features", "care_features"]
# refresh order: every table after the tables it reads
TABLES = [*CHILDREN, "customer_features", "customer_tags"]
_DDL = {
    "subscription_features": "customer_id bigint, active_subscriptions bigint,"
    " monthly_spend decimal(22,2), mobile_lines bigint, broadband_lines bigint,"
    " renewal_lines bigint",
    "billing_features": "customer_id bigint, overdue_amount decimal(22,2)",
    "care_features": "customer_id bigint, open_complaints bigint",
    "customer_features": "customer_id bigint, status string, marketing_consent boolean,"
    " active_subscriptions bigint, monthly_spend decimal(22,2), mobile_lines bigint,"
    " broadband_lines bigint, renewal_lines bigint, overdue_amount decimal(22,2),"
    " open_complaints bigint",
    "customer_tags": "customer_id bigint, rule_version string, high_value int, multi_line int,"
    " payment_risk int, retention_priority int, broadband_cross_sell int,"
    " campaign_suppressed int",
}


#: so many keys at most are taken to the driver and named in a scan
NAMED_KEYS = 500


@dataclass(frozen=True)
class Keys:
    """Customers to recompute; ``n`` is their number."""

    rows: DataFrame
    n: int

    def values(self) -> list[int | None] | None:
        """The keys themselves, if they are few."""
        return _few(self.rows, _KEY) if self.n <= NAMED_KEYS else None

    @cached_property
    def named(self) -> Column | None:
        """The condition that a row belongs to one of a few customers."""
        found = self.values()
        return None if found is None else _one_of(_KEY, found)

    def cut(self, df: DataFrame, spread: list[str]) -> DataFrame:
        """Rows of the customers; tables with one row per customer need no spreading."""
        if self.named is not None:
            return df.filter(self.named)
        if spread:
            return rows_of(df, self.rows, _KEY, spread, self.n)
        return keep_keys(df, sorted_if_many(self.rows, self.n), [_KEY])


def _few(rows: DataFrame, key: str) -> list[int | None] | None:
    """The distinct values of a column, unless there are more than ``NAMED_KEYS``."""
    found = [r[0] for r in rows.select(key).distinct().limit(NAMED_KEYS + 1).collect()]
    return found if len(found) <= NAMED_KEYS else None


def _one_of(key: str, values: Sequence[int | None]) -> Column:
    """Whether a column has one of the values; NULL is a value like any other."""
    known = [v for v in values if v is not None]
    found = F.col(key).isin(known)
    return found | F.col(key).isNull() if len(known) < len(values) else found


class TagTables:
    """The five derived tables below one folder, refreshed in dependency order.

    A refresh is a version. It becomes visible for all five tables at once, when its
    commits are written; a refresh cut short before that is simply run again.

    With ``watched`` the identity of every base table is kept with each version. A base table
    that was replaced without a declared change then makes the tables computed from it, and
    those after them, be rebuilt.
    """

    def __init__(
        self, spark: SparkSession, path: str, full_ratio: float = 0.5, watched: bool = False
    ):
        self.spark, self.path, self.full_ratio = spark, path, full_ratio
        self.inputs = InputLog(spark, f"{path}/inputs") if watched else None
        self.log = CommitLog(spark, f"{path}/commits")
        self.tables = {
            name: KeyedTable(f"{path}/{name}", [_KEY], _DDL[name], self.log) for name in TABLES
        }

    def read(self, name: str = "customer_tags") -> DataFrame:
        return self.tables[name].read()

    def history(self) -> DataFrame:
        """What every refresh did to every table."""
        return self.log.table().drop("kind")

    def build(self, base: BaseTables) -> list[Commit]:
        """First build, or a rebuild of everything."""
        version = self.log.next_version()
        bounds = self._bounds(base)
        done = _at_once(lambda name: self._full(name, base, version, bounds), CHILDREN)
        done += [self._full(name, base, version, bounds) for name in TABLES[len(CHILDREN) :]]
        if self.inputs:
            self.inputs.write(version, identities(base))
        self.log.write()
        return done

    def refresh(self, old: BaseTables, new: BaseTables, changes: Sequence[Change]) -> list[Commit]:
        """Bring all tables from the old base state to the new one."""
        version = self.log.next_version()
        rebuilt: set[str] = set()
        if self.inputs:
            now, replaced = compared(self.inputs.read(version - 1), old, new, changes)
            rebuilt = {FEATURE_OF[name] for name in replaced}
        affected = self._affected(old, new, changes, version)

        def step(name: str, keys: Keys | None) -> Commit:
            if name in rebuilt:
                return self._full(name, new, version, self._bounds(new))
            return self._step(name, new, version, keys)

        # the three children read base tables only
        done = _at_once(lambda name: step(name, affected.get(name)), CHILDREN)
        if rebuilt:  # what reads a rebuilt table has no keys to go by
            rebuilt |= {"customer_features", "customer_tags"}
        reached = [self._reached(c, affected.get(c.table_name)) for c in done]
        reached.append(affected.get("customer_features"))
        keys = self._together([k for k in reached if k is not None], version)
        done.append(step("customer_features", keys))
        if rebuilt:
            done.append(step("customer_tags", keys))
        else:
            done.append(self._tags_step(done[-1], new, version, keys))
        if self.inputs:
            self.inputs.write(version, now)
        self.log.write()
        return done

    def _affected(
        self, old: BaseTables, new: BaseTables, changes: Sequence[Change], version: int
    ) -> dict[str, Keys]:
        """Keys to recompute per table and their number, written down once."""
        by_feature = affected_by_feature(changes, old, new)
        if not by_feature:
            return {}
        folder = f"{self.path}/affected/{version}"
        counts = write_counted(
            union_all(
                [ids.select(F.lit(name).alias("feature"), _KEY) for name, ids in by_feature.items()]
            ),
            folder,
            **{name: F.count_if(F.col("feature") == name) for name in by_feature},
        )
        written = self.spark.read.schema("feature string, customer_id bigint").parquet(folder)
        return {
            name: Keys(written.filter(F.col("feature") == name).select(_KEY), n)
            for name, n in counts.items()
            if n
        }

    def _reached(self, done: Commit, keys: Keys | None) -> Keys | None:
        """Keys whose rows really changed; after a full rebuild, all that might have."""
        if done.kind != "changes":
            return keys
        changed = self.tables[done.table_name].changes([done.version]).select(_KEY)
        n = max(done.rows_inserted, done.rows_deleted)
        return Keys(changed, n) if n else None

    def _together(self, reached: Sequence[Keys], version: int) -> Keys | None:
        """Distinct keys of several sets."""
        if len(reached) < 2:
            return reached[0] if reached else None
        folder = f"{self.path}/reached/{version}"
        counts = write_counted(
            union_all([keys.rows for keys in reached]).distinct(), folder, keys=F.count(F.lit(1))
        )
        return Keys(self.spark.read.schema("customer_id bigint").parquet(folder), counts["keys"])

    def _step(self, name: str, new: BaseTables, version: int, keys: Keys | None) -> Commit:
        table = self.tables[name]
        if keys is None:
            return table.idle(version)
        if keys.n > self.full_ratio * table.size():
            return self._full(name, new, version, self._bounds(new), keys.n)
        if name == "billing_features":
            rows = self._billing(new, keys)
        else:
            rows = self._rows(name, new, keys.cut)
        return table.apply(rows, keys.rows, version, keys.n, keys.named)

    def _billing(self, new: BaseTables, keys: Keys) -> DataFrame:
        """Bills name accounts, not customers: the customers' accounts are looked up first."""
        accounts = keys.cut(new.billing_account, ["account_id"])
        few = None if keys.named is None else _few(accounts, "account_id")
        if few is None:
            # a customer may have any number of accounts
            bills = rows_of(
                new.customer_bill, accounts, "account_id", ["bill_id"], max(keys.n, BROADCAST_ROWS)
            )
        else:
            bills = new.customer_bill.filter(_one_of("account_id", few))
        return f.billing_features(bills, accounts)

    def _tags_step(
        self, features: Commit, new: BaseTables, version: int, keys: Keys | None
    ) -> Commit:
        """Tags follow the features row by row: the rows just written are all they need."""
        found = self._reached(features, keys)
        table = self.tables["customer_tags"]
        if found is None or features.kind != "changes" or found.n > self.full_ratio * table.size():
            return self._step("customer_tags", new, version, found)
        changed = self.tables["customer_features"].changes([version])
        return table.apply(
            customer_tags(changed.filter("NOT _removed")),
            changed.select(_KEY),
            version,
            found.n,
            found.named,
        )

    def _bounds(self, base: BaseTables) -> list[int]:
        """Customer ids that cut the derived tables into as many files as a shuffle has parts."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return range_bounds(base.customer, _KEY, parts)

    def _full(
        self, name: str, base: BaseTables, version: int, bounds: list[int], affected: int = 0
    ) -> Commit:
        rows = self._rows(name, base, lambda df, spread: df)
        return self.tables[name].create(rows, version, affected, bounds)

    def _rows(
        self, name: str, base: BaseTables, reduced: Callable[[DataFrame, list[str]], DataFrame]
    ) -> DataFrame:
        """The definition of a table over inputs cut down to the customers wanted."""
        if name == "subscription_features":
            return f.subscription_features(
                reduced(base.product_inventory, ["subscription_id"]), base.product_offering
            )
        if name == "billing_features":
            return f.billing_features(base.customer_bill, base.billing_account)
        if name == "care_features":
            return f.care_features(reduced(base.trouble_ticket, ["ticket_id"]))
        if name == "customer_features":
            return f.customer_features(
                reduced(base.customer, []), *[reduced(self.read(child), []) for child in CHILDREN]
            )
        return customer_tags(reduced(self.read("customer_features"), []))


def _at_once(step: Callable[[str], Commit], names: Sequence[str]) -> list[Commit]:
    """The steps side by side, so that none waits for another's few jobs."""
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(step, names))


def freshness(history: DataFrame, committed: DataFrame) -> DataFrame:
    """Seconds from the last source commit to finished tags, per version.

    ``committed`` has the columns version and committed_at (a zone-less UTC time).
    """
    ready = (
        history.filter("table_name = 'customer_tags'")
        .groupBy("version")
        .agg(F.max("finished_at").alias("ready_at"))
    )
    last = committed.groupBy("version").agg(F.max("committed_at").alias("committed_at"))
    return ready.join(last, "version").select(
        "version", seconds_between(F.col("committed_at"), F.col("ready_at")).alias("seconds")
    )
