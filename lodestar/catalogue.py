"""The registered queries of the engine, each with SQL for DuckDB that gives the same rows.

SQL queries run through the dialect over the Parquet tables; operator queries through the functions in operators; store
queries load a table into a fresh store, change it, and read it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.functions.expressions import as_number
from lodestar.operators import relational as ops
from lodestar.plans.errors import EngineError
from lodestar.streaming.replica import Replica, Router

Query = Callable[[SparkSession, str], DataFrame]
_DAY = "TIMESTAMP '1998-09-02 00:00:00'"

#: name: (tables, text of the dialect, DuckDB's text or None if it is the same)
SQL: dict[str, tuple[str, str, str | None]] = {
    "flagship": ("lineitem", f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price FROM lineitem WHERE l_shipdate <= {_DAY} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "scan_project": ("nation", "SELECT n_nationkey, n_name FROM nation", None),
    "project_reorder_repeat": ("nation", "SELECT n_name AS a, n_regionkey AS b, n_name AS c FROM nation", None),
    "star_projection": ("region", "SELECT * FROM region", None),
    "star_join": ("nation region", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", None),
    "filter_eq": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = 77", None),
    "filter_ne": ("nation", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2", None),
    "filter_lt": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 5000.0", None),
    "filter_le": ("lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 2.0", None),
    "filter_gt": ("orders", "SELECT o_orderkey FROM orders WHERE 14900 < o_orderkey", None),
    "filter_ge": ("customer", "SELECT c_custkey FROM customer WHERE c_acctbal >= 9000.0", None),
    "filter_string_cmp": ("customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'BUILDING' OR c_name = 'it''s'", None),
    "filter_timestamp": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-02-01 00:00:00'", None),
    "filter_and_or_not": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 3.0 OR l_returnflag = 'N') AND l_linestatus <> 'X'", None),
    "filter_precedence": ("nation", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2 AND NOT n_nationkey + 2 * 3 > 20", None),
    "where_int_truthy": ("nation", "SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "project_arith_int": ("lineitem", "SELECT l_linenumber + 1 AS a, l_linenumber - 2 AS b, l_linenumber * 3 AS c FROM lineitem", None),
    "project_arith_bigint": ("lineitem", "SELECT l_orderkey, l_orderkey * 2 AS a, l_orderkey + l_partkey AS b FROM lineitem", None),
    "project_arith_double": ("lineitem", "SELECT l_orderkey, l_extendedprice * (1.0 - l_discount) AS a, l_extendedprice / l_quantity AS b FROM lineitem", "SELECT l_orderkey, l_extendedprice * (1.0::DOUBLE - l_discount) AS a, l_extendedprice / l_quantity AS b FROM lineitem"),
    "project_int_div": ("lineitem", "SELECT l_orderkey, (0 - l_orderkey) / 7 AS a, (l_linenumber - 4) / 2 AS b FROM lineitem", "SELECT l_orderkey, (0 - l_orderkey) // 7 AS a, CAST((l_linenumber - 4) // 2 AS INTEGER) AS b FROM lineitem"),
    "project_unary": ("lineitem", "SELECT -l_linenumber AS a, -l_tax AS b, +l_orderkey AS c, - -5 AS d FROM lineitem", "SELECT -l_linenumber AS a, -l_tax AS b, l_orderkey AS c, 5 AS d FROM lineitem"),
    "project_predicate_int": ("lineitem", "SELECT l_orderkey, l_quantity > 25.0 AS big, l_returnflag IS NULL AS gone FROM lineitem", "SELECT l_orderkey, CAST(l_quantity > 25 AS INTEGER) AS big, CAST(l_returnflag IS NULL AS INTEGER) AS gone FROM lineitem"),
    "project_literals": ("region", "SELECT r_regionkey, 1 AS i, 5000000000 AS b, 1.5 AS d, 'x''y' AS s, TRUE AS t, DATE '2024-02-29' AS day, TIMESTAMP '2024-02-29 01:02:03.5' AS ts FROM region", "SELECT r_regionkey, 1 AS i, 5000000000 AS b, 1.5::DOUBLE AS d, 'x''y' AS s, TRUE AS t, DATE '2024-02-29' AS day, TIMESTAMP '2024-02-29 01:02:03.5' AS ts FROM region"),
    "project_names": ("region", "SELECT r_name, r_regionkey + 1 r1, region.r_regionkey FROM region", "SELECT r_name, r_regionkey + 1 AS r1, r_regionkey FROM region"),
    "select_without_from": ("region", "SELECT 1 AS one, 7 / 2 AS half", "SELECT 1 AS one, CAST(7 // 2 AS INTEGER) AS half"),
    "join_inner_single": ("orders lineitem", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000.0", None),
    "join_inner_multi": ("lineitem", "SELECT a.l_orderkey, a.l_partkey, b.l_suppkey FROM lineitem a INNER JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45.0", None),
    "join_3way": ("customer orders lineitem", "SELECT c_mktsegment, count(*) AS n, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment", None),
    "join_self": ("nation", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "join_left": ("orders lineitem", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", None),
    "join_semi": ("orders lineitem", "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey", None),
    "join_anti": ("orders lineitem", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey", None),
    "join_theta": ("region", "SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", None),
    "join_equi_and_theta": ("orders customer", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 50.0", None),
    "agg_global_all": ("lineitem", "SELECT count(*) AS n, count(l_tax) AS c, sum(l_linenumber) AS s, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_partkey) AS hi FROM lineitem", "SELECT count(*) AS n, count(l_tax) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_partkey) AS hi FROM lineitem"),
    "agg_global_empty": ("lineitem", "SELECT count(*) AS n, count(l_tax) AS c, sum(l_linenumber) AS s, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM lineitem WHERE l_quantity < 0.0", "SELECT count(*) AS n, count(l_tax) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM lineitem WHERE l_quantity < 0"),
    "agg_group_single": ("orders", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus", None),
    "agg_group_multi": ("lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber", None),
    "agg_of_expression": ("lineitem", "SELECT l_returnflag, sum(l_quantity * 2.0) AS q, sum(l_linenumber) / count(*) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_quantity * 2) AS q, CAST(sum(l_linenumber) AS BIGINT) // count(*) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_sum_widens": ("lineitem", "SELECT sum(l_linenumber * 100000) AS s, sum(l_orderkey) AS t FROM lineitem", "SELECT CAST(sum(l_linenumber * 100000) AS BIGINT) AS s, CAST(sum(l_orderkey) AS BIGINT) AS t FROM lineitem"),
    "agg_minmax_types": ("orders", "SELECT o_orderstatus, min(o_orderpriority) AS a, max(o_orderpriority) AS b, min(o_orderdate) AS c, max(o_orderdate) AS d FROM orders GROUP BY o_orderstatus", None),
    "agg_group_string_timestamp": ("lineitem", "SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_shipdate", None),
    "agg_group_expression": ("lineitem", "SELECT l_orderkey / 100 AS bucket, count(*) AS n FROM lineitem GROUP BY l_orderkey / 100", "SELECT l_orderkey // 100 AS bucket, count(*) AS n FROM lineitem GROUP BY l_orderkey // 100"),
    "group_distinct": ("lineitem", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "having_agg": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", None),
    "having_hidden_agg": ("orders", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 190000.0 ORDER BY sum(o_totalprice)", None),
    "having_no_group": ("region", "SELECT r_name FROM region HAVING r_regionkey > 2", "SELECT r_name FROM region WHERE r_regionkey > 2"),
    "order_by_aggregate_topk": ("lineitem", "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 10", None),
    "order_alias": ("orders", "SELECT o_orderkey, 0.0 - o_totalprice AS p FROM orders ORDER BY p, o_orderkey LIMIT 7", None),
    "order_expression": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_custkey * 10 - o_orderkey, o_orderkey LIMIT 20", None),
    "order_nonprojected": ("customer", "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 5", None),
    "order_by_literal": ("nation", "SELECT n_nationkey FROM nation ORDER BY 1", None),
    "limit": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 13", None),
    "limit_zero": ("orders", "SELECT o_orderkey FROM orders LIMIT 0", None),
    "limit_offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50", None),
    "offset_only": ("nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "pricing_join_report": ("customer orders lineitem nation", "SELECT n_name, count(*) AS n, sum(l_quantity) AS q, max(o_totalprice) AS top FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN nation ON c.c_nationkey = n_nationkey WHERE l_shipdate > TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name HAVING count(*) > 10 ORDER BY n_name", None),
}


def _sql(tables: str, text: str) -> Query:
    return lambda spark, sf_dir: Engine(spark).register_tables(sf_dir, tables.split()).sql(text)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nullable(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The test tables hold no nulls: every seventh value becomes one."""
    return df.withColumn(name, F.when(F.col(key) % 7 != 0, F.col(value)))


_NULLS = "(SELECT *, CASE WHEN {k} % 7 <> 0 THEN {v} END AS {n} FROM {t})"


def scan_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scan(spark, f"{sf_dir}/supplier.parquet", ["s_acctbal", "s_suppkey"])


def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.range_scan(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", 100, 500, ["l_orderkey", "l_linenumber", "l_partkey"])


def scan_range_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.range_scan(spark, f"{sf_dir}/orders.parquet", "o_totalprice", low=150000.0, columns=["o_orderkey"])


def filter_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.where(ops.where(_table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 10), F.col("l_tax") < 0.05)
    return ops.project(df, ["l_orderkey", "l_linenumber"])


def filter_3vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Engine(spark)
    db.register("t", _nullable(_nullable(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "a"), "o_custkey", "o_totalprice", "b"))
    return db.sql("SELECT o_orderkey, a > 700 AND b > 50000.0 AS x, a > 700 OR b > 50000.0 AS y, NOT a > 700 AS z, a IS NULL AS an, b IS NOT NULL AS bn FROM t WHERE NOT (a > 1400 AND b < 20000.0)")


def filter_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Engine(spark)
    db.register("t", _table(spark, sf_dir, "orders").withColumn("flag", F.col("o_totalprice") > 100000))
    return db.sql("SELECT o_orderkey, flag FROM t WHERE flag = TRUE AND flag <> FALSE AND flag")


def filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Engine(spark)
    db.register("t", _table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")))
    return db.sql("SELECT o_orderkey, day FROM t WHERE day > DATE '1997-12-30' AND day <= DATE '1998-01-02'")


def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Engine(spark)
    db.register("t", _nullable(_table(spark, sf_dir, "customer"), "c_custkey", "c_name", "maybe"))
    return db.sql("SELECT c_custkey FROM t WHERE maybe IS NULL")


def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ops.project(_nullable(_table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", "k"), ["n_nationkey", "k"])
    right = ops.project(_nullable(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "j"), ["s_suppkey", "j"])
    return ops.join(left, right, [("k", "j")])


def join_anti_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ops.project(_nullable(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "k"), ["o_orderkey", "k"])
    right = ops.where(_table(spark, sf_dir, "customer"), F.col("c_custkey") % 2 == 0)
    return ops.join(left, right, [("k", "c_custkey")], "anti")


def join_left_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _table(spark, sf_dir, "nation"), ops.where(_table(spark, sf_dir, "supplier"), F.col("s_acctbal") > 5000)
    return ops.project(ops.join(left, right, [("n_nationkey", "s_nationkey")], "left"), ["n_nationkey", "s_suppkey"])


def join_theta_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _table(spark, sf_dir, "nation").alias("a"), _table(spark, sf_dir, "region").alias("b")
    return ops.project(ops.join(a, b, F.col("a.n_regionkey") < F.col("b.r_regionkey")), ["n_nationkey", "r_regionkey"])


def agg_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nullable(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "flag")
    return ops.aggregate(df, ["flag"], {"n": ("count", None), "c": ("count", "flag"), "q": ("sum", "l_quantity"), "a": ("avg", "l_linenumber")})


def agg_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "nation").withColumn("v", F.lit(None).cast("int"))
    return ops.aggregate(df, [], {"n": ("count", None), "c": ("count", "v"), "s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "v")})


def _ordered(descending: bool, nulls_first: bool = False) -> Query:
    """Sort order shown by numbering the sorted rows, as results are compared without order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import Window

        df = _nullable(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "v")
        key = ops.sort_key(F.col("v"), descending, nulls_first)
        return df.select("n_nationkey", F.row_number().over(Window.orderBy(key, F.col("n_nationkey"))).cast("long").alias("place"))

    return run


def sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nullable(_table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", "v")
    return ops.project(ops.limit(ops.sort(df, [("v", True), ("o_orderkey",)]), 10, 3), ["o_orderkey", "v"])


def project_expression_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.project(_table(spark, sf_dir, "part"), {"k": "p_partkey", "double_size": F.col("p_size") * 2, "big": as_number(F.col("p_size") > 25), "one": F.lit(1)})


def pipeline_filter_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ops.where(_table(spark, sf_dir, "lineitem"), F.col("l_quantity") >= 20)
    both = ops.join(lines, _table(spark, sf_dir, "part"), [("l_partkey", "p_partkey")])
    out = ops.aggregate(both, ["p_brand"], {"n": ("count", None), "q": ("sum", "l_quantity"), "top": ("max", "p_size")})
    return ops.limit(ops.sort(ops.where(out, F.col("n") > 5), [("q", True), "p_brand"]), 10)


def _store(spark: SparkSession, **options: bool) -> Engine:
    """An engine on a fresh folder that all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Engine.open(spark, f"{top.rstrip('/')}/store-{uuid.uuid4().hex}", **options)


def _customers(spark: SparkSession, sf_dir: str, more: str = "", **options: bool) -> Engine:
    db = _store(spark, **options)
    db.sql(f"CREATE TABLE c (id BIGINT PRIMARY KEY, name VARCHAR(40) NOT NULL, nation INT, balance DOUBLE, segment VARCHAR(20)) {more}")
    db.insert_frame("c", _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))
    return db


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.sql("INSERT INTO c (name, id) VALUES ('new', -1), ('newer', -2)")
    db.sql("INSERT INTO c SELECT id + 1000000, name, nation, balance, segment FROM c WHERE id >= 0 AND id <= 10")
    return db.sql("SELECT * FROM c")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.sql("UPDATE c SET balance = balance + 1.0, nation = nation * 2 WHERE segment = 'BUILDING'")
    return db.sql("SELECT id, nation, balance FROM c")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir, automatic=False)
    db.sql("DELETE FROM c WHERE balance < 0.0 OR nation = 3")
    return db.sql("SELECT id, name FROM c")


def dml_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    n = db.sql("DELETE FROM c").rows
    return db.sql(f"SELECT {n} AS deleted, count(*) AS left_over FROM c")


def dml_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir, automatic=False)
    db.sql("DELETE FROM c WHERE nation < 10")
    n = db.sql("VACUUM c").rows
    return db.sql(f"SELECT {n} AS reclaimed, count(*) AS n, sum(id) AS ids FROM c")


def ddl_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _store(spark)
    db.sql("CREATE TABLE t (id INT, n INT DEFAULT 99, d DATE DEFAULT DATE '2024-03-01', s VARCHAR(9) DEFAULT 'none')")
    db.sql("INSERT INTO t (id, n) VALUES (1, 5), (2, NULL)")
    return db.sql("SELECT * FROM t")


def constraint_unique_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _store(spark)
    db.sql("CREATE TABLE t (a INT, b INT, UNIQUE (a, b)); INSERT INTO t VALUES (1, NULL), (1, NULL), (1, 2)")
    return db.sql("SELECT * FROM t")


def show_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sql("CREATE INDEX by_nation ON c (nation, balance); SHOW INDEXES FROM c")


def _indexed(where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _store(spark)
        db.sql("CREATE TABLE o (id BIGINT, k BIGINT)")
        db.insert_frame("o", _nullable(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "k").select(F.col("o_orderkey").alias("id"), "k"))
        return db.sql(f"CREATE INDEX by_k ON o (k); SELECT id, k FROM o WHERE {where}")

    return run


def _partitioned(spark: SparkSession, sf_dir: str) -> Engine:
    db = _store(spark)
    db.sql("CREATE TABLE o (id BIGINT NOT NULL, price DOUBLE) PARTITION BY RANGE (id) (PARTITION a VALUES LESS THAN (1000) ON 'n1:1', PARTITION b VALUES LESS THAN (10000) ON 'n2:1', PARTITION c VALUES LESS THAN MAXVALUE ON 'n3:1')")
    db.insert_frame("o", _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))
    return db


def partition_prune_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitioned(spark, sf_dir).sql("SELECT id FROM o WHERE id <= 1000 AND id > 990")


def partition_global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitioned(spark, sf_dir).sql("SELECT count(*) AS n, sum(id) AS ids, min(price) AS lo, max(price) AS hi FROM o")


def partition_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitioned(spark, sf_dir).sql("SELECT id, price FROM o ORDER BY price DESC, id LIMIT 5")


def partition_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each partition, as its files hold them."""
    db = _partitioned(spark, sf_dir)
    state, out = db.store.state("o"), None
    for name, _, _ in state.partitions:
        files = [db.store.files.uri(f.name) for f in state.files if f.partition == name]
        df = (spark.read.schema(state.schema).parquet(*files) if files else spark.createDataFrame([], state.schema)).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = df if out is None else out.unionByName(df)
    return out


def alter_add_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _partitioned(spark, sf_dir)
    db.sql("ALTER TABLE o ADD PARTITION d VALUES LESS THAN (12000) ON 'n4:1'")
    return db.sql("SELECT count(*) AS n, sum(id) AS ids FROM o WHERE id >= 10000 AND id < 12000")


def partition_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _partitioned(spark, sf_dir)
    db.sql("UPDATE o SET price = 0.0 WHERE id < 1000; DELETE FROM o WHERE id >= 10000")
    return db.sql("SELECT count(*) AS n, max(id) AS top, min(price) AS lo FROM o")


def replica_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir, automatic=False)
    replica = Replica(spark, db.root, db.root + "-replica")
    replica.catch_up()
    db.sql("DELETE FROM c WHERE nation = 1; UPDATE c SET balance = 0.0 WHERE nation = 2")
    replica.catch_up()
    return Engine.open(spark, db.root + "-replica").sql("SELECT id, nation, balance FROM c")


def replica_after_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica that comes late: tables dropped, rows vacuumed away and old files cleaned on the leader before it first looks."""
    db = _customers(spark, sf_dir, automatic=False)
    db.sql("CREATE TABLE gone (x INT); INSERT INTO gone VALUES (1), (2); DROP TABLE gone; DELETE FROM c WHERE nation < 5; VACUUM c")
    db.store.clean("c")
    replica = Replica(spark, db.root, db.root + "-late")
    replica.catch_up()
    db.sql("DELETE FROM c WHERE nation = 7; VACUUM c")
    db.store.clean("c")
    replica.catch_up()
    return Engine.open(spark, db.root + "-late").sql("SELECT id, nation FROM c")


def replica_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica that begins after the log was shortened."""
    db = _customers(spark, sf_dir)
    db.store.truncate_log()
    db.sql("INSERT INTO c (id, name, nation) VALUES (-5, 'x', 1)")
    Replica(spark, db.root, db.root + "-snapshot").catch_up()
    return Engine.open(spark, db.root + "-snapshot").sql("SELECT id, nation FROM c")


def read_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads go to the replicas in turn, so the second does not see what the first has; writes go to the leader."""
    db = _customers(spark, sf_dir)
    copies = []
    for name in ("a", "b"):
        Replica(spark, db.root, f"{db.root}-{name}").catch_up()
        copies.append(Engine.open(spark, f"{db.root}-{name}"))
        Router(db, []).sql("INSERT INTO c (id, name) VALUES (-1, 'x')" if name == "a" else "INSERT INTO c (id, name) VALUES (-2, 'x')")
    route = Router(db, copies)
    found = [route.sql("SELECT count(*) AS n FROM c").withColumn("turn", F.lit(i)) for i in range(3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened anew from the log, with files beside it that no commit names."""
    db = _customers(spark, sf_dir, automatic=False)
    db.sql("DELETE FROM c WHERE nation > 20")
    _table(spark, sf_dir, "nation").write.parquet(db.store.files.uri("c/data-ffff"))
    return Engine.open(spark, db.root).sql("SELECT id, nation FROM c")


def auto_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond a fifth of dead rows a statement leaves none behind."""
    db = _customers(spark, sf_dir)
    db.sql("DELETE FROM c WHERE nation < 10")
    state = db.store.state("c")
    return db.sql(f"SELECT {state.dead} AS dead, {len(state.deletions)} AS deletions, count(*) AS n FROM c")


def merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small commits end up in few files."""
    db = _store(spark)
    db.sql("CREATE TABLE t (id INT)")
    for i in range(34):
        db.sql(f"INSERT INTO t VALUES ({i})")
    few = int(len(db.store.state("t").files) < 8)
    return db.sql(f"SELECT {few} AS few, count(*) AS n, sum(id) AS ids FROM t")


def show_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SHOW TABLES, COLUMNS and CONSTRAINTS say, as one table."""
    db = _store(spark)
    db.sql("CREATE TABLE a (id INT PRIMARY KEY, v VARCHAR(20) NOT NULL DEFAULT 'x', UNIQUE (v, id)); CREATE TABLE b (x DOUBLE); CREATE INDEX i ON b (x); DROP INDEX i ON b; CREATE TABLE z (x INT); DROP TABLE z; DROP TABLE IF EXISTS z")
    out = db.sql("SHOW TABLES").select(F.lit("table").alias("what"), F.col("table_name").alias("name"), F.lit("").alias("more"))
    out = out.unionByName(db.sql("SHOW COLUMNS FROM a").select(F.lit("column").alias("what"), F.col("column_name").alias("name"), F.concat_ws(" ", "type", "nullable", "default").alias("more")))
    out = out.unionByName(db.sql("SHOW CONSTRAINTS FROM a").select(F.lit("constraint").alias("what"), F.col("kind").alias("name"), F.col("columns").alias("more")))
    return out.unionByName(db.sql("SHOW INDEXES FROM b").select(F.lit("index").alias("what"), F.col("index_name").alias("name"), F.col("columns").alias("more")))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that must fail, by their number, with the kind of error; and what they left of the table."""
    db = _store(spark)
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v VARCHAR(3) NOT NULL); INSERT INTO t VALUES (1, 'a')")
    texts = ["INSERT INTO t VALUES (1, 'b')", "INSERT INTO t VALUES (2, 'b'), (2, 'c')", "INSERT INTO t VALUES (3, NULL)", "INSERT INTO t VALUES (4, 'long')", "UPDATE t SET v = 'toolong'", "SELECT v FROM t GROUP BY id", "SELECT nope FROM t", "SELECT sum(count(*)) FROM t", "SELEC 1", "DROP TABLE nope", "CREATE TABLE t (x INT)"]
    rows = []
    for i, text in enumerate(texts):
        try:
            db.sql(text)
            rows.append((i, "none"))
        except EngineError as e:
            rows.append((i, type(e).__name__))
    for i, text in enumerate(["SELECT id / 0 AS x FROM t", "SELECT 2147483647 + id AS x FROM t"], len(texts)):
        try:
            db.sql(text).collect()
            rows.append((i, "none"))
        except PySparkException as e:
            rows.append((i, (e.getCondition() or "").split(".")[0]))
    return spark.createDataFrame(rows, "statement int, error string").crossJoin(db.sql("SELECT count(*) AS n, max(v) AS v FROM t"))


_ORDER_SQL = "SELECT n_nationkey, row_number() OVER (ORDER BY v {o}, n_nationkey) AS place FROM " + _NULLS.format(k="n_nationkey", v="n_name", n="v", t="nation")
_ORDERS_K = _NULLS.format(k="o_orderkey", v="o_custkey", n="k", t="orders")

#: name: (query, SQL for DuckDB)
OPERATORS: dict[str, tuple[Query, str]] = {
    "scan_subset": (scan_subset, "SELECT s_acctbal, s_suppkey FROM supplier"),
    "scan_range": (scan_range, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 500"),
    "scan_range_open": (scan_range_open, "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000"),
    "filter_chained": (filter_chained, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.05::DOUBLE"),
    "filter_3vl": (filter_3vl, "WITH t AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS a, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS b FROM orders) SELECT o_orderkey, CAST(a > 700 AND b > 50000 AS INTEGER) AS x, CAST(a > 700 OR b > 50000 AS INTEGER) AS y, CAST(NOT a > 700 AS INTEGER) AS z, CAST(a IS NULL AS INTEGER) AS an, CAST(b IS NOT NULL AS INTEGER) AS bn FROM t WHERE NOT (a > 1400 AND b < 20000)"),
    "filter_bool": (filter_bool, "SELECT o_orderkey, TRUE AS flag FROM orders WHERE o_totalprice > 100000"),
    "filter_date": (filter_date, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-12-30' AND CAST(o_orderdate AS DATE) <= DATE '1998-01-02'"),
    "filter_is_null": (filter_is_null, "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0"),
    "join_null_keys": (join_null_keys, f"SELECT n_nationkey, k, s_suppkey, j FROM {_NULLS.format(k='n_nationkey', v='n_regionkey', n='k', t='nation')} JOIN {_NULLS.format(k='s_suppkey', v='s_nationkey', n='j', t='supplier')} ON k = j"),
    "join_anti_null_keys": (join_anti_null_keys, f"SELECT o_orderkey, k FROM {_ORDERS_K} a WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey = a.k)"),
    "join_left_operator": (join_left_operator, "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey"),
    "join_theta_operator": (join_theta_operator, "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "agg_null_group": (agg_null_group, f"SELECT flag, count(*) AS n, count(flag) AS c, sum(l_quantity) AS q, avg(l_linenumber) AS a FROM {_NULLS.format(k='l_partkey', v='l_returnflag', n='flag', t='lineitem')} GROUP BY flag"),
    "agg_all_null": (agg_all_null, "SELECT count(*) AS n, 0::BIGINT AS c, NULL::BIGINT AS s, NULL::DOUBLE AS a, NULL::INTEGER AS lo FROM nation"),
    "order_nulls_last_asc": (_ordered(False), _ORDER_SQL.format(o="ASC NULLS LAST")),
    "order_nulls_last_desc": (_ordered(True), _ORDER_SQL.format(o="DESC NULLS LAST")),
    "order_nulls_first": (_ordered(False, True), _ORDER_SQL.format(o="ASC NULLS FIRST")),
    "sort_topk": (sort_topk, f"SELECT o_orderkey, v FROM {_NULLS.format(k='o_orderkey', v='o_totalprice', n='v', t='orders')} ORDER BY v DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 3"),
    "project_expression_operator": (project_expression_operator, "SELECT p_partkey AS k, p_size * 2 AS double_size, CAST(p_size > 25 AS INTEGER) AS big, 1 AS one FROM part"),
    "pipeline_filter_join_agg": (pipeline_filter_join_agg, "SELECT p_brand, count(*) AS n, sum(l_quantity) AS q, max(p_size) AS top FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 20 GROUP BY p_brand HAVING count(*) > 5 ORDER BY q DESC, p_brand LIMIT 10"),
    "dml_insert": (dml_insert, "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey <= 10 UNION ALL SELECT * FROM (VALUES (-1, 'new', NULL, NULL, NULL), (-2, 'newer', NULL, NULL, NULL))"),
    "dml_update": (dml_update, "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey * 2 ELSE c_nationkey END AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer"),
    "dml_delete": (dml_delete, "SELECT c_custkey AS id, c_name AS name FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey = 3)"),
    "dml_delete_all": (dml_delete_all, "SELECT CAST(count(*) AS INTEGER) AS deleted, 0::BIGINT AS left_over FROM customer"),
    "dml_vacuum": (dml_vacuum, "SELECT CAST(count(*) FILTER (c_nationkey < 10) AS INTEGER) AS reclaimed, count(*) FILTER (c_nationkey >= 10) AS n, CAST(sum(c_custkey) FILTER (c_nationkey >= 10) AS BIGINT) AS ids FROM customer"),
    "ddl_defaults": (ddl_defaults, "SELECT * FROM (VALUES (1, 5, DATE '2024-03-01', 'none'), (2, 99, DATE '2024-03-01', 'none')) t(id, n, d, s)"),
    "constraint_unique_null": (constraint_unique_null, "SELECT * FROM (VALUES (1, NULL), (1, NULL), (1, 2)) t(a, b)"),
    "show_indexes": (show_constraints, "SELECT * FROM (VALUES ('pk_c', 'id', TRUE), ('by_nation', 'nation, balance', FALSE)) t(index_name, columns, is_unique)"),
    "index_lookup": (_indexed("k = 77"), f"SELECT o_orderkey AS id, k FROM {_ORDERS_K} WHERE k = 77"),
    "index_range_dups": (_indexed("k > 1490"), f"SELECT o_orderkey AS id, k FROM {_ORDERS_K} WHERE k > 1490"),
    "index_lt_null": (_indexed("k <= 10"), f"SELECT o_orderkey AS id, k FROM {_ORDERS_K} WHERE k <= 10"),
    "partition_route": (partition_route, "SELECT part, coalesce(n, 0) AS n FROM (VALUES ('a'), ('b'), ('c')) p(part) LEFT JOIN (SELECT CASE WHEN o_orderkey < 1000 THEN 'a' WHEN o_orderkey < 10000 THEN 'b' ELSE 'c' END AS part, count(*) AS n FROM orders GROUP BY 1) USING (part)"),
    "partition_prune_boundary": (partition_prune_boundary, "SELECT o_orderkey AS id FROM orders WHERE o_orderkey <= 1000 AND o_orderkey > 990"),
    "partition_global_agg": (partition_global_agg, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders"),
    "partition_topk": (partition_topk, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 5"),
    "alter_add_partition": (alter_add_partition, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_orderkey >= 10000 AND o_orderkey < 12000"),
    "partition_update": (partition_update, "SELECT count(*) AS n, max(o_orderkey) AS top, min(CASE WHEN o_orderkey < 1000 THEN 0 ELSE o_totalprice END) AS lo FROM orders WHERE o_orderkey < 10000"),
    "replica_apply": (replica_apply, "SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_nationkey = 2 THEN 0 ELSE c_acctbal END AS balance FROM customer WHERE c_nationkey <> 1"),
}


OPERATORS |= {
    "replica_after_drop": (replica_after_drop, "SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey >= 5 AND c_nationkey <> 7"),
    "replica_snapshot": (replica_snapshot, "SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT -5, 1"),
    "read_router": (read_router, "SELECT count(*) + d AS n, turn::INTEGER AS turn FROM customer, (VALUES (0, 0), (1, 1), (0, 2)) t(d, turn) GROUP BY d, turn"),
    "recovery": (recovery, "SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey <= 20"),
    "auto_vacuum": (auto_vacuum, "SELECT 0 AS dead, 0 AS deletions, count(*) AS n FROM customer WHERE c_nationkey >= 10"),
    "merge_files": (merge_files, "SELECT 1 AS few, 34::BIGINT AS n, 561::BIGINT AS ids"),
    "show_all": (show_all, "SELECT * FROM (VALUES ('table', 'a', ''), ('table', 'b', ''), ('column', 'id', 'INT false'), ('column', 'v', 'VARCHAR(20) false x'), ('constraint', 'PRIMARY KEY', 'id'), ('constraint', 'UNIQUE', 'v, id')) t(what, name, more)"),
    "rejected": (rejected, "SELECT i::INTEGER AS statement, e AS error, 1::BIGINT AS n, 'a' AS v FROM (VALUES (0, 'ConstraintError'), (1, 'ConstraintError'), (2, 'ConstraintError'), (3, 'ConstraintError'), (4, 'ConstraintError'), (5, 'BindError'), (6, 'BindError'), (7, 'BindError'), (8, 'ParseError'), (9, 'BindError'), (10, 'BindError'), (11, 'DIVIDE_BY_ZERO'), (12, 'ARITHMETIC_OVERFLOW')) t(i, e)"),
}


def queries() -> dict[str, Query]:
    return {**{name: _sql(tables, text) for name, (tables, text, _) in SQL.items()}, **{name: query for name, (query, _) in OPERATORS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: duck or text for name, (_, text, duck) in SQL.items()}, **{name: duck for name, (_, duck) in OPERATORS.items()}}
