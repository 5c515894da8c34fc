"""Guarded execution of untrusted read-only SQL: text check, plan allow-list, row cap, deadline, one run a distinct query.

A query's rows are written by the executors, keyed, as Parquet under a digest of the query and of what its views hold;
the driver keeps one status a query.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent import storage
from querent.functions.canonical import with_keys
from querent.functions.sqltext import validate_read_only
from querent.plans import dialect

OK, REJECTED, ERROR, TIMEOUT = "ok", "rejected", "error", "timeout"
#: Seconds and rows of a query; results kept by an executor.
TIMEOUT_S, MAX_ROWS, KEPT = 10.0, 10_000, 200_000

#: Logical nodes a query may parse to; everything else is refused.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedWithCTERelations CTERelationDef CTERelationRef WithCTE OneRowRelation LocalRelation UnresolvedInlineTable UnresolvedHaving "
    "UnresolvedSubqueryColumnAliases WithWindowDefinition Window Generate Pivot UnresolvedPivot Unpivot Expand UnionLoop UnionLoopRef Tail".split()
)
#: Functions that reach outside the query.
REFUSED = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true "
    "current_user user session_user current_catalog current_database current_schema version read_files".split()
)


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


#: Rows of a stored result.
STORED = "exec_id string, row_idx int, canon array<string>, exact array<string>"


class ResultStore:
    """Results as Parquet, a folder each, under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or storage.scratch(spark, "results")

    def write(self, digest: str, name: str, df: DataFrame, most: int) -> int:
        """Store the first most + 1 rows of df, keyed and numbered in their order; how many these are."""
        keyed = with_keys(df.limit(most + 1)).coalesce(1)  # a result is capped
        rows = keyed.select(F.lit(name).alias("exec_id"), F.monotonically_increasing_id().cast("int").alias("row_idx"), "canon", "exact")
        rows.write.mode("overwrite").parquet(f"{self.folder}/{digest}")
        return self.rows([digest]).count()

    def rows(self, digests: Iterable[str]) -> DataFrame:
        """STORED rows of results."""
        paths = [f"{self.folder}/{d}" for d in dict.fromkeys(digests)]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def drop(self, digest: str) -> None:
        storage.delete(self.spark, f"{self.folder}/{digest}")


@dataclass(frozen=True)
class Execution:
    """How one query ended; its rows lie in a store under digest."""

    status: str
    n_rows: int = 0
    columns: tuple[str, ...] = ()
    error: str | None = None
    elapsed_s: float = 0.0
    truncated: bool = False
    digest: str | None = None
    store: ResultStore | None = field(default=None, repr=False, compare=False)

    @property
    def ok(self) -> bool:
        return self.status == OK

    @property
    def rows(self) -> tuple:
        """(canonical, exact) keys in result order, read from the store: for looking at one result."""
        if not self.ok or self.store is None:
            return ()
        found = self.store.rows([self.digest]).where(F.col("row_idx") < self.n_rows).orderBy("row_idx")
        return tuple((tuple(r.canon), tuple(r.exact)) for r in found.collect())


def fingerprint(spark: SparkSession, relations: Iterable[str]) -> str:
    """A digest of what views hold: their plans, and the files behind them with sizes and times of change."""
    parts = []
    for name in sorted(relations):
        try:
            frame = spark.table(name)
        except Exception:  # a view that isn't there is told by the query that names it
            parts.append((name, None))
            continue
        own = frame._jdf.queryExecution().optimizedPlan()
        files = []
        for leaf in _seq(own.collectLeaves()):
            if hasattr(leaf, "relation") and leaf.getClass().getSimpleName() == "LogicalRelation":
                relation = leaf.relation()
                if relation.getClass().getSimpleName() == "HadoopFsRelation":
                    index = relation.location()
                    if index.getClass().getSimpleName() == "InMemoryFileIndex":
                        files.append(index.allFiles().hashCode())  # of their paths
                    for root in _seq(index.rootPaths()):
                        status = root.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(root)
                        files.append((root.toString(), status.getLen(), status.getModificationTime()))
        parts.append((name, frame.schema.json(), frame.semanticHash(), str(own.stats().sizeInBytes()), files))
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def refusal(spark: SparkSession, sql: str, relations: Iterable[str]) -> str | None:
    """Why a plan isn't allowed, or None; independent of any look at the text.

    Every node, common table expression and subquery must be on the allow-list; relations are one-part names
    among relations or the query's own expressions, never paths; functions are built in and not refused ones.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names = {r.lower() for r in relations}
    registry = spark._jsparkSession.sessionState().functionRegistry()
    builtin = {f.funcName().lower() for f in _seq(registry.listFunction().toSeq())} if hasattr(registry, "listFunction") else set()
    own: set[str] = set()
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        found.append((kind, node))
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                own.add(pair._1().lower())
                nodes.append(pair._2())
        nodes += _seq(node.children())
        nodes += [n for n in _seq(node.innerChildren()) if hasattr(n, "subqueries")]
        expressions = _seq(node.expressions())
        while expressions:
            e = expressions.pop()
            name = e.getClass().getSimpleName()
            if name == "UnresolvedFunction":
                parts = [p.lower() for p in _seq(e.nameParts())]
                if len(parts) != 1 or parts[0] in REFUSED or (builtin and parts[0] not in builtin):
                    return f"function {'.'.join(parts)} is not allowed"
            if name.endswith("Subquery") or name in ("Exists", "ListQuery", "InSubquery", "FunctionTableSubqueryArgumentExpression"):
                try:
                    nodes.append(e.plan())
                except Exception:  # its plan is in a child, which is walked below
                    pass
            expressions += _seq(e.children())
        nodes += _seq(node.subqueries())
    for kind, node in found:
        if kind == "UnresolvedTableValuedFunction":
            parts = [p.lower() for p in _seq(node.name())]
            if parts not in (["range"], ["explode"], ["posexplode"]):
                return f"table function {'.'.join(parts)} is not allowed"
        elif kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names | own:
                return f"relation {'.'.join(parts)} is not allowed"
        elif kind not in NODES:
            return f"{kind} is not allowed"
    return None


@dataclass
class SqlExecutor:
    """Runs queries over the named temporary views of one session; equal queries over equal views run once unless they timed out.

    Results stay in the store, the KEPT last used ones; older ones are deleted before the next queries run, so frames
    that were given out stay readable until then. A deadline cancels the query's jobs; a task ends when it next looks
    at its interruption, so one deep in a nested loop can hold its core a while longer.
    """

    spark: SparkSession
    relations: tuple[str, ...]
    timeout_s: float = TIMEOUT_S
    max_rows: int = MAX_ROWS
    stats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("calls", "cache_hits", OK, REJECTED, ERROR, TIMEOUT), 0))
    store: ResultStore | None = None
    #: "spark", or "sqlite" for statements of SQLite's dialect, as far as plans.dialect renders it.
    dialect: str = "spark"

    def __post_init__(self):
        self.store = self.store or ResultStore(self.spark)
        self._kept: OrderedDict[str, tuple[str, Execution]] = OrderedDict()
        self._lock = threading.Lock()

    def validate(self, queries: list[str]) -> dict[str, tuple[bool, str, str | None]]:
        """(ok, statement, reason) of each query text."""
        if not queries:
            return {}
        frame = self.spark.createDataFrame([(q,) for q in queries], "sql string")
        return {r.sql: tuple(r.v) for r in frame.select("sql", validate_read_only(F.col("sql")).alias("v")).collect()}

    def execute(self, sql: str, validate: bool = True, use_cache: bool = True, checked: tuple | None = None, views: str | None = None) -> Execution:
        """Run one query, or give what it gave before; checked is what validate() said of it and views the fingerprint of the relations, if known."""
        if views is None:
            self._forget()
        digest = hashlib.sha256("\0".join((sql, views or fingerprint(self.spark, self.relations), str(self.max_rows))).encode()).hexdigest()[:32]
        with self._lock:
            self.stats["calls"] += 1
            if use_cache and digest in self._kept:
                self.stats["cache_hits"] += 1
                self._kept.move_to_end(digest)
                return self._kept[digest][1]
        found = self._run(sql, digest if use_cache else uuid.uuid4().hex, validate, checked)
        with self._lock:
            self.stats[found.status] += 1
            if use_cache and found.status != TIMEOUT:
                self._kept[digest] = sql, found
        return found

    def kept(self) -> list[str]:
        """The queries whose results are kept, the last used at the end."""
        return [sql for sql, _ in self._kept.values()]

    def _forget(self, most: int | None = None) -> None:
        """Delete the least recently used results beyond most."""
        with self._lock:
            while len(self._kept) > (KEPT if most is None else most):
                _, (_, old) = self._kept.popitem(last=False)
                if old.ok:
                    self.store.drop(old.digest)

    def clear_cache(self) -> None:
        self._forget(0)

    def execute_many(self, queries: Iterable[str], workers: int = 4) -> dict[str, Execution]:
        """Each distinct query once, several at a time on the session's scheduler."""
        distinct = list(dict.fromkeys(q for q in queries if q))
        self._forget()
        checked, views = self.validate(distinct), fingerprint(self.spark, self.relations)
        with ThreadPoolExecutor(workers) as pool:
            return dict(zip(distinct, pool.map(lambda q: self.execute(q, checked=checked[q], views=views), distinct), strict=True))

    def _run(self, sql: str, digest: str, validate: bool, checked: tuple | None) -> Execution:
        began = time.monotonic()
        statement = sql
        if validate:
            fine, statement, reason = checked or self.validate([sql])[sql]
            if not fine:
                return Execution(REJECTED, error=reason, elapsed_s=time.monotonic() - began)
        try:
            if self.dialect == "sqlite":
                statement = dialect.parsed(self.spark, statement, self.relations)
            if reason := refusal(self.spark, statement, self.relations):
                return Execution(REJECTED if validate else ERROR, error=reason, elapsed_s=time.monotonic() - began)
        except Exception as e:  # the parser's
            return Execution(ERROR, error=_shown(e), elapsed_s=time.monotonic() - began)
        tag, out = f"guard-{uuid.uuid4().hex}", {}

        def write(real: bool) -> None:
            df = self.spark.sql(dialect.typed(self.spark, statement, real) if self.dialect == "sqlite" else statement)
            out["columns"] = tuple(df.columns)
            out["n"] = self.store.write(digest, sql, df, self.max_rows)

        def work() -> None:
            self.spark.sparkContext.addJobTag(tag)
            self.spark.sparkContext.setInterruptOnCancel(True)
            try:
                write(False)
            except Exception as e:
                out["error"] = _shown(e)
                if self.dialect == "sqlite" and "ARITHMETIC_OVERFLOW" in str(e):
                    try:
                        write(True)
                        del out["error"]
                    except Exception as again:
                        out["error"] = _shown(again)

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(self.timeout_s)
        late = thread.is_alive()
        if late:
            self.spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(5)
        elapsed = time.monotonic() - began
        if late:
            return Execution(TIMEOUT, error=f"stopped after {self.timeout_s:g} s", elapsed_s=elapsed)
        if "error" in out:
            return Execution(ERROR, error=out["error"], elapsed_s=elapsed, columns=out.get("columns", ()))
        return Execution(OK, min(out["n"], self.max_rows), out["columns"], None, elapsed, out["n"] > self.max_rows, digest, self.store)

    def frames(self, executions: dict[str, Execution]) -> tuple[DataFrame, DataFrame]:
        """(results, rows) of executions as frames for verify.compare_runs; exec_id is the query text. Rows are read where they lie."""
        results = [(q, e.status, e.n_rows, len(e.columns), e.truncated, e.error, float(e.elapsed_s)) for q, e in executions.items()]
        rows = self.store.rows(e.digest for e in executions.values() if e.ok).where(F.col("row_idx") < self.max_rows)
        return self.spark.createDataFrame(results, "exec_id string, status string, n_rows int, n_cols int, truncated boolean, error string, elapsed_s double"), rows


def execute_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], timeout_s: float = TIMEOUT_S, max_rows: int = MAX_ROWS, validate: bool = True) -> Execution:
    """Run one query over the given frames in a session of its own that keeps nothing but the result; what fails before it runs is an error's result.

    Views are the frames' resolved plans, so filters and columns reach their sources, and the caller's own views stay
    out of reach.
    """
    try:
        own = spark.newSession()
        dataset = getattr(spark._jvm.org.apache.spark.sql.classic, "Dataset")
        for name, df in views.items():
            DataFrame(dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()), own).createOrReplaceTempView(name)
        return SqlExecutor(own, tuple(views), timeout_s, max_rows).execute(sql, validate=validate, use_cache=False)
    except Exception as e:
        return Execution(ERROR, error=_shown(e))


def _shown(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0][:300] if str(error) else ''}"
