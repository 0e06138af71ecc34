"""Every operator as a query over the test tables, with its expected result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import columns as C
from flowsieve.functions import labels as L
from flowsieve.operators import balance, classes, metrics, prep, selection
from flowsieve.operators.cascade import combine, routing
from flowsieve.operators.isolation import IsolationForest, detector_code
from flowsieve.operators.models import (
    Classifier,
    fit_boosted,
    fit_forest,
    fit_logistic,
    timed,
)
from flowsieve.operators.quantiles import quantiles
from flowsieve.operators.smote import smote
from flowsieve.operators.split import TEST, TRAIN, stratified_split
from flowsieve.plans import oracle as O
from flowsieve.plans import prepare
from flowsieve.plans.experiments import (
    anomaly_sweep,
    binary_baselines,
    binary_rows,
    cascade,
    fit_on_smote,
    multiclass,
    report_rows,
    training_base,
    transfer,
)
from flowsieve.session import local_frame, scratch_path, small_methods, stage
from flowsieve.sources import flows_csv, standins, tables
from flowsieve.sources.standins import LINEITEM_KEY, VECTOR, table

TRANSFER_SPLIT = O.split_ctes(O.LINEITEM_SHARED, "is_attack", ", ".join(LINEITEM_KEY))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where there is one."""

    def add(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def rounded(df: DataFrame, names, digits: int = 6) -> DataFrame:
    names = set(names)
    return df.select(
        *[F.round(C.ref(c), digits).alias(c) if c in names else C.ref(c) for c in df.columns]
    )


KEY_TEXT = ", ".join(LINEITEM_KEY)

# ---------------------------------------------------------------- sources and sinks


def _write_cic(spark, sf_dir: str) -> str:
    """Headered files in two layouts: other column order, and one column missing."""
    raw = standins.cic_raw(spark, sf_dir)
    root = scratch_path(spark, "cic-csv")
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "encoding": flows_csv.ENCODING}
    small = C.ref(" Total Fwd Packets").cast("int") <= 25
    turned = raw.filter(~small).select(*[C.ref(c) for c in reversed(raw.columns) if c != " Source IP"])
    with small_methods(spark):
        raw.filter(small).write.csv(f"{root}/a", **options)
        turned.write.csv(f"{root}/b", **options)
    return f"{root}/*/*.csv"


CIC_READ = f"""cells AS ({O.CIC_CELLS}),
  raw AS (SELECT flow_id,
    CASE WHEN CAST(total_fwd_packets AS INTEGER) <= 25 THEN source_ip END AS source_ip,
    {', '.join(O.CIC_FEATURES)}, CASE WHEN label NOT IN ({O.MISSING}) THEN label END AS label FROM cells)"""


@query(f"WITH {CIC_READ} SELECT * FROM raw")
def csv_scan_headered(spark, sf_dir):
    return flows_csv.scan_headered(spark, _write_cic(spark, sf_dir))


@query(f"""WITH {CIC_READ} SELECT {', '.join(
    f'{O.number(a.replace(" ", "_"))} AS {b}' for a, b in prepare.CIC_SHARED.items() if a != 'label')},
    CAST(coalesce(label, 'nan') NOT ILIKE '%benign%' AS INTEGER) AS is_attack FROM raw""")
def csv_shared_columns(spark, sf_dir):
    raw = flows_csv.scan_headered(
        spark, _write_cic(spark, sf_dir), keep_spaces=True, columns=list(prepare.CIC_SHARED)
    )
    return prepare.cic_shared(raw)


def _write_unsw(spark, sf_dir: str) -> str:
    path = scratch_path(spark, "unsw-csv")
    with small_methods(spark):
        standins.unsw_raw(spark, sf_dir).write.csv(
            path, header=False, encoding=flows_csv.ENCODING,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    return path


@query(O.UNSW_CELLS)
def csv_scan_headerless(spark, sf_dir):
    return flows_csv.scan_headerless(spark, _write_unsw(spark, sf_dir))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
  FROM lineitem WHERE l_quantity > 10 GROUP BY ALL""")
def parquet_scan(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus", "l_quantity"]
    rows = tables.read_table(spark, f"{sf_dir}/lineitem.parquet", columns).filter("l_quantity > 10")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(f"""WITH {O.split_ctes('SELECT * FROM orders', 'o_orderstatus', 'o_orderkey')}
  SELECT o_orderkey, o_orderstatus, o_totalprice FROM marked WHERE split = 'test'""")
def parquet_split_sink(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "orders-split")
    tables.write_splits(stratified_split(orders, "o_orderstatus", ["o_orderkey"]), path)
    return tables.read_split(spark, path, TEST)


BINARY_SQL = f"""ev AS ({O.EVENTS}), cells AS ({O.BINARY_CELLS}),
  pr AS (SELECT *, {O.ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy,
    {O.ratio('tp', 'tp + fp')} AS precision, {O.ratio('tp', 'tp + fn')} AS recall,
    {O.ratio('fp', 'fp + tn')} AS far FROM cells),
  scores AS (SELECT tn, fp, fn, tp, accuracy, precision, recall,
    {O.ratio('2 * precision * recall', 'precision + recall')} AS f1, far FROM pr)"""


@query(f"""WITH {BINARY_SQL}, long AS (SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'far']) AS metric,
    unnest([accuracy, precision, recall, f1, far]) AS value FROM scores)
  SELECT 'events' AS experiment, 'rule' AS model, 'all' AS split, '' AS class, metric,
    round(value, 9) AS value FROM long""")
def json_metrics_sink(spark, sf_dir):
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "is_attack", "rule")
    rows = metrics.metric_rows(
        metrics.binary_metrics(pairs), "events", "rule", "all",
        ["accuracy", "precision", "recall", "f1", "far"],
    )
    path = scratch_path(spark, "metrics")
    tables.write_json(rows, path)
    return rounded(tables.read_json(spark, path, metrics.METRIC_SCHEMA), ["value"], 9)


@query(f"""WITH {TRANSFER_SPLIT} SELECT is_attack, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM marked
  WHERE split = 'test' GROUP BY ALL""")
def model_persistence(spark, sf_dir):
    """Predictions of a saved and loaded model, detector and scaler, against the fitted ones.

    The rows are stored before they are scaled, so the loaded scaler makes what the loaded models see.
    """
    data = _shared_data(spark, sf_dir)
    path = scratch_path(spark, "models")
    model = fit_logistic(data.train, "is_attack", data.features)
    forest = _isolation(data).with_offset(-0.5)
    model.save(spark, f"{path}/logistic")
    forest.save(spark, f"{path}/isolation")
    data.unscaled().save(f"{path}/data")
    again = prepare.load_prepared(spark, f"{path}/data").scaled()

    def verdicts(test, one, two, name):
        scored = two.predict(one.predict(test))
        return scored.select(*LINEITEM_KEY, "is_attack", F.struct("prediction", "scores", "code").alias(name))

    before = verdicts(data.test, model, forest, "before")
    after = verdicts(again.test, Classifier.load(spark, f"{path}/logistic"), IsolationForest.load(spark, f"{path}/isolation"), "after")
    both = before.join(after, [*LINEITEM_KEY, "is_attack"], "full")
    differing = F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing")
    return both.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), differing)


# ---------------------------------------------------------------- projections and cleaning


@query("""SELECT l_quantity, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""")
def header_normalise(spark, sf_dir):
    dirty = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias(" L Quantity"),
        F.col("l_tax").alias("L Tax "),
        F.col("l_returnflag").alias("L_ReturnFlag"),
    )
    clean = C.normalise_header(dirty)
    return clean.groupBy(*clean.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_quantity AS "l quantity", l_tax AS "l tax", count(*) AS n FROM lineitem GROUP BY ALL""")
def header_normalise_spaces(spark, sf_dir):
    dirty = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias(" L Quantity"), F.col("l_tax").alias("L Tax ")
    )
    clean = C.normalise_header(dirty, keep_spaces=True)
    return clean.groupBy(*[C.ref(c) for c in clean.columns]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders")
def drop_leakage_columns(spark, sf_dir):
    leaky = ["o_orderdate", "o_custkey", "source_ip", "timestamp"]
    return C.drop_columns(table(spark, sf_dir, "orders"), leaky)


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def feature_selection(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    labels = [*LINEITEM_KEY, "l_returnflag", "l_linestatus"]
    return items.select(*C.feature_columns(items, labels))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_column_selection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(*C.numeric_columns(orders))


@query("SELECT o_totalprice AS duration, o_orderstatus AS label FROM orders")
def rename_select_lenient(spark, sf_dir):
    mapping = {"o_totalprice": "duration", "no such column": "src_packets", "o_orderstatus": "label"}
    return C.rename_select(table(spark, sf_dir, "orders"), mapping, strict=False)


@query("SELECT l_quantity AS src_packets, l_tax AS src_iat_mean, l_returnflag AS label FROM lineitem")
def rename_select_strict(spark, sf_dir):
    mapping = {"l_quantity": "src_packets", "l_tax": "src_iat_mean", "l_returnflag": "label"}
    return C.rename_select(table(spark, sf_dir, "lineitem"), mapping, strict=True)


@query(f"SELECT event_id, {O.number('amount')} AS amount FROM ({O.DIRTY_EVENTS})")
def numeric_coerce(spark, sf_dir):
    dirty = standins.dirty_events(spark, sf_dir).select("event_id", "amount")
    return C.coerce_numeric(dirty, ["amount"])


INF_CASE = """CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END"""


@query(f"SELECT event_id, {INF_CASE} AS value FROM events")
def infinite_to_null(spark, sf_dir):
    odd = F.pmod(F.col("event_id"), F.lit(33))
    value = (
        F.when(odd == 0, F.lit(float("inf"))).when(odd == 11, F.lit(float("-inf")))
        .when(odd == 22, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    events = table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return C.infinite_to_null(events)


@query(f"""SELECT event_id, CASE WHEN amount NOT IN (' ', '-') THEN amount END IS NULL AS missing,
  length(CASE WHEN label NOT IN (' ', '-') THEN label END) AS label_length FROM ({O.DIRTY_EVENTS})""")
def sentinels_to_null(spark, sf_dir):
    clean = C.sentinels_to_null(standins.dirty_events(spark, sf_dir))
    return clean.select(
        "event_id", F.col("amount").isNull().alias("missing"), F.length("label").cast("bigint").alias("label_length")
    )


@query(f"""SELECT event_id, {O.strip("coalesce(label, 'Normal')")} AS label FROM ({O.DIRTY_EVENTS})""")
def fill_and_strip_label(spark, sf_dir):
    dirty = standins.dirty_events(spark, sf_dir)
    return dirty.select("event_id", L.filled_label(F.col("label")).alias("label"))


STRIPPED = O.strip("coalesce(label, 'nan')")
DASHED = f"replace(regexp_replace({STRIPPED}, '[\\x{{2013}}\\x{{2014}}\\x{{96}}]', '-', 'g'), chr(160), ' ')"
CHAIN = f"""regexp_replace(regexp_replace({DASHED}, '{O.SPACE}+', ' ', 'g'),
  'Web Attack\\s*-\\s*', 'Web Attack ', 'g')"""


@query(f"""SELECT event_id, {STRIPPED} AS stripped,
  CASE WHEN contains(upper({STRIPPED}), 'BENIGN') THEN 'BENIGN' ELSE {STRIPPED} END AS benign,
  CASE WHEN lower({CHAIN}) = 'web attack sql injection' THEN 'Web Attack Sql Injection' ELSE {CHAIN} END AS attack
  FROM ({O.DIRTY_EVENTS})""")
def label_normalise(spark, sf_dir):
    text = L.label_text(F.col("label"))
    return standins.dirty_events(spark, sf_dir).select(
        "event_id",
        text.alias("stripped"),
        L.canonical_benign(text).alias("benign"),
        L.canonical_attack(text).alias("attack"),
    )


@query(f"""SELECT count(*) AS n, count(*) FILTER (label IS NULL OR {O.strip('label')} = ''
  OR lower({O.strip('label')}) = 'nan') AS missing FROM ({O.DIRTY_EVENTS})""")
def missing_label_count(spark, sf_dir):
    return standins.dirty_events(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(L.is_missing_label(F.col("label"))).alias("missing")
    )


ATTACK_LABEL = f"""SELECT event_id, CASE WHEN lower({CHAIN}) = 'web attack sql injection'
  THEN 'Web Attack Sql Injection' ELSE {CHAIN} END AS label FROM ({O.DIRTY_EVENTS})"""
OFFICIAL = ", ".join(O.text(c) for c in L.OFFICIAL_LABELS)


def _clean_labels(spark, sf_dir):
    label = L.canonical_attack(L.label_text(F.col("label")))
    return standins.dirty_events(spark, sf_dir).select("event_id", label.alias("label"))


@query(f"SELECT event_id, label FROM ({ATTACK_LABEL}) WHERE label IN ({OFFICIAL})")
def label_allowlist(spark, sf_dir):
    return L.keep_allowed(_clean_labels(spark, sf_dir), "label")


@query(f"SELECT DISTINCT label FROM ({ATTACK_LABEL}) WHERE label NOT IN ({OFFICIAL})")
def label_rejects(spark, sf_dir):
    return L.rejected_labels(_clean_labels(spark, sf_dir), "label")


@query(f"""SELECT doc_id, CAST(quality IS DISTINCT FROM 1 AS INTEGER) AS is_attack,
  quality IS NULL AS unlabelled FROM ({O.DOC_LABELS})""")
def binary_label_nulls(spark, sf_dir):
    """A document without a label counts as an attack."""
    docs = standins.doc_labels(spark, sf_dir)
    name = F.when(F.col("quality") == 1, F.lit(L.BENIGN)).when(F.col("quality") == 0, F.lit("junk"))
    return docs.select(
        "doc_id", L.is_attack(name).alias("is_attack"), F.col("quality").isNull().alias("unlabelled")
    )


@query("""SELECT l_orderkey, l_quantity * 1000000::DOUBLE AS l_quantity, l_tax * 1000::DOUBLE AS l_tax
  FROM lineitem""")
def unit_conversion(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return C.scale_units(items, {"l_quantity": 1e6, "l_tax": 1e3})


@query("""SELECT CASE WHEN value > 60 THEN 1 ELSE 0 END AS flag, count(*) AS n FROM events GROUP BY 1""")
def anomaly_code_map(spark, sf_dir):
    code = detector_code(-F.col("value"), -60.0)
    flagged = table(spark, sf_dir, "events").select(L.anomaly_flag(code).alias("flag"))
    return flagged.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT * FROM (
  SELECT 'majority' AS part, o_orderstatus, count(*) AS n FROM orders
    WHERE o_orderstatus = (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY ALL
  UNION ALL SELECT 'minority', o_orderstatus, count(*) FROM orders
    WHERE o_orderstatus <> (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY ALL)""")
def majority_partition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    top = classes.majority_class(orders, "o_orderstatus").first()[0]
    most, rest = classes.partition_rows(orders, F.col("o_orderstatus") == top)
    return (
        most.select(F.lit("majority").alias("part"), "o_orderstatus")
        .unionByName(rest.select(F.lit("minority").alias("part"), "o_orderstatus"))
        .groupBy("part", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    )


@query("""SELECT doc_id, lang || '/' || source AS class_name FROM documents WHERE lang || '/' || source IN
  (SELECT lang || '/' || source FROM documents GROUP BY 1 HAVING count(*) >= 6)""")
def known_class_rows(spark, sf_dir):
    docs = _doc_classes(spark, sf_dir).select("doc_id", "class_name")
    known = classes.class_dictionary(balance.drop_rare(docs, "class_name"), "class_name")
    return classes.keep_known(docs, "class_name", known)


DICTIONARY = """all_classes AS (SELECT class_name, CAST(row_number() OVER (ORDER BY class_name) - 1 AS INTEGER) AS class_idx
    FROM (SELECT DISTINCT lang || '/' || source AS class_name FROM documents)),
  kept AS (SELECT lang || '/' || source AS class_name FROM documents GROUP BY 1 HAVING count(*) >= 6),
  dense AS (SELECT class_name, class_idx, CAST(row_number() OVER (ORDER BY class_idx) - 1 AS INTEGER) AS dense_idx
    FROM all_classes WHERE class_name IN (SELECT class_name FROM kept))"""


def _doc_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("class_name")
    )


def _dense(spark, sf_dir):
    docs = _doc_classes(spark, sf_dir)
    dictionary = classes.class_dictionary(docs, "class_name")
    kept = balance.drop_rare(docs, "class_name").select("class_name")
    return docs, dictionary, classes.dense_reindex(dictionary, kept)


@query(f"WITH {DICTIONARY} SELECT * FROM dense")
def dense_reindex(spark, sf_dir):
    return _dense(spark, sf_dir)[2]


@query(f"""WITH {DICTIONARY} SELECT doc_id, class_idx, dense_idx, class_name AS decoded
  FROM (SELECT doc_id, lang || '/' || source AS class_name FROM documents) JOIN dense USING (class_name)""")
def dense_reindex_round_trip(spark, sf_dir):
    """Classes to gap-free numbers and back to names."""
    docs, dictionary, dense = _dense(spark, sf_dir)
    kept = classes.keep_known(docs, "class_name", dense)
    numbered = classes.encode(kept, "class_name", dictionary, "class_idx")
    side = dense.select("class_name", F.col("dense_idx").alias("class_idx"))
    numbered = classes.encode(numbered, "class_name", side, "dense_idx")
    return classes.decode(numbered, "dense_idx", side, "decoded").select(
        "doc_id", "class_idx", "dense_idx", "decoded"
    )


def _event_classes(flows: DataFrame) -> list:
    return classes.class_names(flows, "event_type")


@query(f"""SELECT event_id, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS class,
  unnest([CAST(event_type = 'click' AS INTEGER), CAST(event_type = 'error' AS INTEGER),
    CAST(event_type = 'purchase' AS INTEGER), CAST(event_type = 'signup' AS INTEGER),
    CAST(event_type = 'view' AS INTEGER)]) AS hit,
  unnest([value, k, 0.0::DOUBLE, value + k, 0.0::DOUBLE]) AS score FROM ({O.EVENTS})""")
def spread_class_scores(spark, sf_dir):
    """A model of three classes reported over all five."""
    flows = standins.events_flows(spark, sf_dir)
    scores = F.array(F.col("value"), F.col("k"), F.col("value") + F.col("k"))
    names = _event_classes(flows)
    spread = classes.spread_scores(scores, ["click", "error", "signup"], names)
    scored = flows.withColumn("scores", spread)
    return classes.long_scores(scored, "event_type", "scores", names, ["event_id"])


# ---------------------------------------------------------------- aggregates


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def class_counts(spark, sf_dir):
    return classes.class_counts(table(spark, sf_dir, "events"), "event_type")


@query(f"SELECT quality, count(*) AS n FROM ({O.DOC_LABELS}) GROUP BY 1")
def class_counts_with_null(spark, sf_dir):
    return classes.class_counts(standins.doc_labels(spark, sf_dir), "quality")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def majority_class(spark, sf_dir):
    return classes.majority_class(table(spark, sf_dir, "events"), "event_type")


@query("SELECT DISTINCT p_brand AS class FROM part")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("class")).distinct()


@query(f"SELECT count(*) AS n, count(*) FILTER (rule = 1) AS flagged FROM ({O.EVENTS})")
def row_counts(spark, sf_dir):
    return standins.events_flows(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule") == 1).alias("flagged")
    )


@query(f"SELECT round(avg(is_attack), 9) AS attack_frequency FROM ({O.EVENTS})")
def attack_frequency(spark, sf_dir):
    return standins.events_flows(spark, sf_dir).agg(
        F.round(F.avg("is_attack"), 9).alias("attack_frequency")
    )


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM_SPLIT = O.split_ctes(
    "SELECT * EXCLUDE (l_shipdate) FROM lineitem", "l_returnflag", ", ".join(LINEITEM_KEY)
)


def _lineitem_split(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, *NUMERIC, "l_returnflag")
    return stratified_split(items, "l_returnflag", LINEITEM_KEY)


def _quantile_frame(spark, found: dict, names) -> DataFrame:
    return local_frame(
        spark,
        [(c, *values) for c, values in found.items()],
        "feature string, " + ", ".join(f"{n} double" for n in names),
    )


@query(f"WITH {LINEITEM_SPLIT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM marked WHERE split = 'train'" for c in NUMERIC))
def train_medians(spark, sf_dir):
    train = stage(_lineitem_split(spark, sf_dir).select(*NUMERIC, "split"), "marked")
    train = train.filter(F.col("split") == TRAIN)
    found = quantiles(train, NUMERIC, [0.5])
    return rounded(_quantile_frame(spark, found, ["median"]), ["median"])


@query(f"WITH {LINEITEM_SPLIT} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
    round(quantile_cont({c}, 0.75), 6) AS q75 FROM marked WHERE split = 'train'""" for c in NUMERIC))
def train_quartiles(spark, sf_dir):
    train = stage(_lineitem_split(spark, sf_dir).select(*NUMERIC, "split"), "marked")
    train = train.filter(F.col("split") == TRAIN)
    # Few values are ranked at once, so that narrowing runs at this size too.
    found = quantiles(train, NUMERIC, prep.QUARTILES, ranked_rows=20)
    return rounded(_quantile_frame(spark, found, ["q25", "q50", "q75"]), ["q25", "q50", "q75"])


@query(f"""SELECT bool_or(price IS NULL) AS price, bool_or(customer IS NULL) AS customer,
  bool_or(constant IS NULL) AS constant FROM ({O.HOLED_ORDERS})""")
def any_null(spark, sf_dir):
    return prep.any_null(standins.holed_orders(spark, sf_dir), ["price", "customer", "constant"])


# ---------------------------------------------------------------- splits and rebalancing

SHARED = ", ".join(prepare.SHARED_FEATURES)


@query(f"""SELECT {SHARED}, is_attack FROM ({O.LINEITEM_SHARED})
  UNION ALL SELECT {SHARED}, is_attack FROM ({O.EVENTS_SHARED})""")
def shared_schema_union(spark, sf_dir):
    items = prepare.in_schema(standins.lineitem_shared(spark, sf_dir), prepare.SHARED_FEATURES)
    events = prepare.in_schema(standins.events_shared(spark, sf_dir), prepare.SHARED_FEATURES)
    return items.unionByName(events)


@query("""SELECT l_orderkey, l_quantity, l_tax, CAST(l_linestatus = 'O' AS DOUBLE) AS l_linestatus_O,
  l_returnflag AS label FROM lineitem""")
def attach_columns(spark, sf_dir):
    """Features, encoded categories and labels stay in one row: nothing to glue."""
    items = table(spark, sf_dir, "lineitem")
    return prep.OneHot.fit(items, ["l_linestatus"]).transform(
        items.select("l_orderkey", "l_quantity", "l_tax", "l_linestatus", F.col("l_returnflag").alias("label"))
    )


@query(f"""WITH {O.split_ctes(O.EVENTS, 'is_attack', 'event_id')} SELECT event_id, is_attack, split FROM marked""")
def stratified_split_binary(spark, sf_dir):
    marked = stratified_split(standins.events_flows(spark, sf_dir), "is_attack", ["event_id"])
    return marked.select("event_id", "is_attack", "split")


@query(f"""WITH {O.split_ctes('SELECT * FROM orders', 'o_orderpriority', 'o_orderkey')}
  SELECT o_orderkey, o_orderpriority, split FROM marked""")
def stratified_split_multiclass(spark, sf_dir):
    marked = stratified_split(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])
    return marked.select("o_orderkey", "o_orderpriority", "split")


@query(f"""WITH {LINEITEM_SPLIT} SELECT l_returnflag, split, count(*) AS n FROM marked GROUP BY ALL""")
def stratified_split_counts(spark, sf_dir):
    marked = _lineitem_split(spark, sf_dir)
    return marked.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {O.split_ctes(
    'SELECT *, ' + O.row_id(['l_linenumber', 'l_returnflag']).replace('"l_linenumber"', 'CAST(l_linenumber AS VARCHAR)')
    + ' AS rid FROM lineitem', 'l_returnflag', 'rid')}
  SELECT l_linenumber, l_returnflag, split, count(*) AS n FROM marked GROUP BY ALL""")
def stratified_split_copies(spark, sf_dir):
    """Rows which are copies of each other by the thousand: quotas still hold exactly."""
    items = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag")
    marked = stratified_split(
        prepare.with_row_id(items), "l_returnflag", [prepare.ROW_ID], copies=True
    )
    return marked.groupBy("l_linenumber", "l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TRANSFER_SPLIT} SELECT CASE split WHEN 'test' THEN 'validation' ELSE split END AS part,
    is_attack, count(*) AS n FROM marked GROUP BY ALL
  UNION ALL SELECT 'external', is_attack, count(*) FROM ({O.EVENTS_SHARED}) GROUP BY ALL""")
def train_validation_external(spark, sf_dir):
    marked = stratified_split(standins.lineitem_shared(spark, sf_dir), "is_attack", LINEITEM_KEY)
    part = F.when(F.col("split") == TEST, F.lit("validation")).otherwise(F.col("split"))
    away = standins.events_shared(spark, sf_dir).select(F.lit("external").alias("part"), "is_attack")
    return (
        marked.select(part.alias("part"), "is_attack").unionByName(away)
        .groupBy("part", "is_attack").agg(F.count(F.lit(1)).alias("n"))
    )


TAKEN = """placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY md5(concat_ws('|', '42', o_orderkey))) AS place FROM orders)"""
TOP_STATUS = "(SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"""WITH {TAKEN} SELECT o_orderkey, o_orderstatus FROM placed
  WHERE o_orderstatus = {TOP_STATUS} AND place <= 300""")
def downsample_majority(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    top = classes.majority_class(orders, "o_orderstatus").first()[0]
    majority, _ = classes.partition_rows(orders, F.col("o_orderstatus") == top)
    return selection.take_n(majority, 300, ["o_orderkey"])


@query(f"""WITH {TAKEN} SELECT o_orderkey, o_orderstatus FROM placed
  WHERE o_orderstatus <> 'F' OR place <= 1000000000""")
def downsample_named_class(spark, sf_dir):
    """A class smaller than the wanted number stays whole."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return balance.downsample(orders, "o_orderstatus", 1_000_000_000, ["o_orderkey"], name="F")


@query(f"""WITH {TAKEN} SELECT o_orderkey, o_orderstatus FROM placed
  WHERE o_orderstatus <> {TOP_STATUS} OR place <= 500""")
def balanced_baseline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return balance.downsample(orders, "o_orderstatus", 500, ["o_orderkey"])


DOC_CLASS = "SELECT doc_id, lang || '/' || source AS class_name FROM documents"


@query(f"""SELECT doc_id, class_name FROM ({DOC_CLASS}) WHERE class_name IN
  (SELECT class_name FROM ({DOC_CLASS}) GROUP BY 1 HAVING count(*) >= 6)""")
def rare_class_drop(spark, sf_dir):
    return balance.drop_rare(_doc_classes(spark, sf_dir), "class_name")


@query(f"SELECT class_name, count(*) AS n FROM ({DOC_CLASS}) GROUP BY 1 HAVING count(*) < 6")
def rare_class_report(spark, sf_dir):
    return balance.rare_classes(_doc_classes(spark, sf_dir), "class_name")


@query("""WITH sizes AS (SELECT quality, toxic, count(*) AS c FROM labels GROUP BY ALL)
  SELECT doc_id, round((SELECT sum(c) FROM sizes)::DOUBLE / ((SELECT count(*) FROM sizes)::DOUBLE * c), 9) AS weight
  FROM labels JOIN sizes USING (quality, toxic)""")
def balanced_weights(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    name = F.concat_ws("/", "quality", "toxic")
    return rounded(balance.balanced_weights(labels, name), ["weight"], 9).select("doc_id", "weight")


@query(f"""WITH {O.SMOTE_POINTS}
  SELECT label, {', '.join(f'round(x[{i + 1}], 6) AS {f}' for i, f in enumerate(VECTOR))} FROM made""")
def smote_exact(spark, sf_dir):
    """Only the made rows; neighbours are exact and found block by block."""
    vectors = standins.vector_flows(spark, sf_dir)
    made = smote(vectors, "label", VECTOR, ["vec_id"], block_rows=200, only_new=True)
    return rounded(made.drop("synthetic"), VECTOR)


@query("""WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
  SELECT label, (SELECT max(n) FROM sizes) AS n, (SELECT max(n) FROM sizes) - n AS made FROM sizes""")
def smote_class_sizes(spark, sf_dir):
    vectors = standins.vector_flows(spark, sf_dir)
    raised = smote(vectors, "label", VECTOR, ["vec_id"])
    return raised.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("made")
    )


# ---------------------------------------------------------------- feature fitting

HOLED_SPLIT = O.split_ctes(O.HOLED_ORDERS, "o_orderstatus", "o_orderkey")
HOLED = ("price", "customer", "constant")


def _holed(spark, sf_dir):
    marked = stratified_split(standins.holed_orders(spark, sf_dir), "o_orderstatus", ["o_orderkey"])
    marked = stage(marked, "marked")
    train = marked.filter(F.col("split") == TRAIN)
    return marked, prep.FeaturePrep.fit(train, [*HOLED, "empty"])


@query(f"""WITH {HOLED_SPLIT}, med AS (SELECT median(price) AS m FROM marked WHERE split = 'train')
  SELECT o_orderkey, split, round(coalesce(price, m), 6) AS price, customer, constant FROM marked, med""")
def impute_median(spark, sf_dir):
    marked, fitted = _holed(spark, sf_dir)
    return rounded(fitted.impute(marked), ["price"]).select("o_orderkey", "split", *HOLED)


@query(f"""WITH {HOLED_SPLIT}, {O.scaled_ctes(HOLED, ['o_orderkey', 'split'])}
  SELECT o_orderkey, split, {O.rounded(HOLED)} FROM scaled""")
def robust_scale(spark, sf_dir):
    """Fitted on training rows; a constant column is divided by one, an empty one left out."""
    marked, fitted = _holed(spark, sf_dir)
    return rounded(fitted.transform(marked), HOLED).drop("o_orderstatus")


@query(f"""WITH {HOLED_SPLIT}, {O.scaled_ctes(HOLED, ['o_orderkey', 'split'])}
  SELECT 'price' AS feature, round(m.price, 6) AS median, round(q.price[2], 6) AS center,
    round(q.price[3] - q.price[1], 6) AS spread FROM med m, quarters q
  UNION ALL SELECT 'customer', round(m.customer, 6), round(q.customer[2], 6),
    round(q.customer[3] - q.customer[1], 6) FROM med m, quarters q
  UNION ALL SELECT 'constant', round(m.constant, 6), round(q.constant[2], 6), 1.0 FROM med m, quarters q
  UNION ALL SELECT 'empty', NULL, NULL, NULL""")
def fitted_statistics(spark, sf_dir):
    _, fitted = _holed(spark, sf_dir)
    frame = fitted.to_frame(spark).drop("position")
    return rounded(frame, ["median", "center", "spread"])


PART_TYPES = """SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS p_type FROM part"""
ONE_HOT = ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(f"""WITH {O.split_ctes(PART_TYPES, 'p_brand', 'p_partkey')},
  late AS (SELECT p_partkey, split, CASE WHEN split = 'test' AND p_partkey % 5 = 0 THEN 'UNSEEN' ELSE p_type END AS p_type FROM marked)
  SELECT p_partkey, split, {', '.join(f"CAST(p_type IS NOT DISTINCT FROM '{c}' AS DOUBLE) AS p_type_{c}" for c in ONE_HOT)},
    CAST(p_type IS NULL AS DOUBLE) AS p_type_nan FROM late""")
def one_hot(spark, sf_dir):
    """Categories of the training rows; first dropped, NULL its own, unseen all zeros."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("p_type")
    )
    marked = stratified_split(parts, "p_brand", ["p_partkey"]).drop("p_brand")
    unseen = (F.col("split") == TEST) & (F.col("p_partkey") % 5 == 0)
    late = marked.withColumn("p_type", F.when(unseen, F.lit("UNSEEN")).otherwise(F.col("p_type")))
    encoder = prep.OneHot.fit(late.filter(F.col("split") == TRAIN), ["p_type"])
    return encoder.transform(late)


@query("""WITH d AS (SELECT event_type AS class_name, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS class_idx
    FROM (SELECT DISTINCT event_type FROM events))
  SELECT event_id, event_type, class_idx FROM events JOIN d ON event_type = class_name""")
def label_encode(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    dictionary = classes.class_dictionary(events, "event_type")
    return classes.encode(events, "event_type", dictionary, "class_idx")


@query("""SELECT CAST(count(DISTINCT event_type) AS INTEGER) AS class_idx FROM events WHERE event_type < 'purchase'""")
def class_position(spark, sf_dir):
    dictionary = classes.class_dictionary(table(spark, sf_dir, "events"), "event_type")
    return classes.class_position(dictionary, "purchase")


@query("""SELECT e.event_id, c.class, CAST(e.event_type = c.class AS INTEGER) AS hit
  FROM events e, (SELECT DISTINCT event_type AS class FROM events) c""")
def label_binarize(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    names = classes.class_names(events, "event_type")
    return classes.binarize(events, "event_type", names, "class", "hit").drop("event_type")


@query(f"""WITH {TRANSFER_SPLIT},
  {O.scaled_ctes(prepare.SHARED_FEATURES, ['split', 'is_attack', *LINEITEM_KEY])},
  away AS (SELECT 'external' AS split, is_attack, {', '.join(
      f'(coalesce(t.{c}, m.{c}) - q.{c}[2]) / (q.{c}[3] - q.{c}[1]) AS {c}' for c in prepare.SHARED_FEATURES)}
    FROM ({O.EVENTS_SHARED}) t, med m, quarters q),
  every AS (SELECT split, is_attack, {SHARED} FROM scaled UNION ALL SELECT split, is_attack, {SHARED} FROM away)
  SELECT split, is_attack, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in prepare.SHARED_FEATURES)}
  FROM every GROUP BY ALL""")
def fit_on_train_only(spark, sf_dir):
    """Statistics of the training part applied to training, held-out and foreign rows."""
    home = stratified_split(standins.lineitem_shared(spark, sf_dir), "is_attack", LINEITEM_KEY)
    away = standins.events_shared(spark, sf_dir).withColumn("split", F.lit("external"))
    fitted = prep.FeaturePrep.fit(home.filter(F.col("split") == TRAIN), prepare.SHARED_FEATURES)
    columns = ["split", "is_attack", *prepare.SHARED_FEATURES]
    every = fitted.transform(home.select(columns).unionByName(away.select(columns)))
    return every.groupBy("split", "is_attack").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), 6).alias(c) for c in prepare.SHARED_FEATURES],
    )


# ---------------------------------------------------------------- whole preparations

CIC_NUMBERS = ", ".join(f"{O.number(c)} AS {c}" for c in O.CIC_FEATURES)
CIC_BASE = f"""WITH {CIC_READ}, ided AS (SELECT *, {O.row_id(O.CIC_ORDER)} AS rid,
    {O.strip("coalesce(label, 'nan')")} AS text FROM raw)"""
CIC_SUMS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in O.CIC_FEATURES)


def _split_summary(data: prepare.Prepared, label: str) -> DataFrame:
    return data.table.groupBy("split", label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(C.ref(f)), 6).alias(f) for f in data.features],
    )


CIC_BINARY = O.split_ctes(
    f"""{CIC_BASE} SELECT rid, {CIC_NUMBERS}, CAST(NOT contains(upper(text), 'BENIGN') AS INTEGER) AS is_attack
    FROM ided""", "is_attack", "rid")


@query(f"""WITH {CIC_BINARY}, {O.scaled_ctes(O.CIC_FEATURES, ['split', 'is_attack'])}
  SELECT split, is_attack, count(*) AS n, {CIC_SUMS} FROM scaled GROUP BY ALL""")
def prepare_cic_binary(spark, sf_dir):
    raw = flows_csv.scan_headered(spark, _write_cic(spark, sf_dir), text=["label"])
    return _split_summary(prepare.cic_binary(raw), "is_attack")


CIC_MULTI = O.split_ctes(
    f"""{CIC_BASE}, named AS (SELECT * FROM ided WHERE text IN ({OFFICIAL}))
    SELECT rid, {CIC_NUMBERS}, CAST(dense_rank() OVER (ORDER BY text) - 1 AS INTEGER) AS multiclass_label
    FROM named""", "multiclass_label", "rid")


@query(f"""WITH {CIC_MULTI}, {O.scaled_ctes(O.CIC_FEATURES, ['split', 'multiclass_label'])}
  SELECT split, multiclass_label, count(*) AS n, {CIC_SUMS} FROM scaled GROUP BY ALL""")
def prepare_cic_multiclass(spark, sf_dir):
    raw = flows_csv.scan_headered(spark, _write_cic(spark, sf_dir), text=["label"])
    return _split_summary(prepare.cic_multiclass(raw), "multiclass_label")


UNSW_NUMBERS = [
    c for c in flows_csv.UNSW_COLUMNS
    if c not in (*prepare.UNSW_LEAKY, *prepare.UNSW_CATEGORICAL, "attack_cat", "Label")
]
UNSW_FLAGS = [("proto", "ospf"), ("proto", "tcp"), ("proto", "udp"), ("state", "O"), ("service", "http"), ("service", None)]
UNSW_FLAG_NAMES = [f"{c}_{v or 'nan'}" for c, v in UNSW_FLAGS]
UNSW_SPLIT = O.split_ctes(
    f"""SELECT {O.row_id(flows_csv.UNSW_COLUMNS)} AS rid, {', '.join(f'{O.number(c)} AS "{c}"' for c in UNSW_NUMBERS)},
    {', '.join(f"CAST(nullif({c}, '-') IS NOT DISTINCT FROM {O.text(v)} AS DOUBLE) AS {n}" for (c, v), n in zip(UNSW_FLAGS, UNSW_FLAG_NAMES))},
    {O.strip("coalesce(attack_cat, 'Normal')")} AS multiclass_label FROM ({O.UNSW_CELLS})""",
    "multiclass_label", "rid")
UNSW_FEATURES = [*UNSW_NUMBERS, *UNSW_FLAG_NAMES]


@query(f"""WITH {UNSW_SPLIT}, {O.scaled_ctes(UNSW_FEATURES, ['split', 'multiclass_label'])}
  SELECT split, multiclass_label, count(*) AS n, {', '.join(f'round(avg("{c}"), 6) AS "{c}"' for c in UNSW_FEATURES)}
  FROM scaled GROUP BY ALL""")
def prepare_unsw(spark, sf_dir):
    raw = flows_csv.scan_headerless(spark, _write_unsw(spark, sf_dir), text=prepare.UNSW_TEXT)
    return _split_summary(prepare.unsw(raw), "multiclass_label")


@query(f"""SELECT {', '.join(f'{O.number(a)} * {prepare.UNSW_UNITS.get(b, 1.0)}::DOUBLE AS {b}'
    for a, b in prepare.UNSW_SHARED.items() if b != 'is_attack')}, CAST("Label" AS INTEGER) AS is_attack
  FROM ({O.UNSW_CELLS})""")
def unsw_shared_columns(spark, sf_dir):
    return prepare.unsw_shared(standins.unsw_raw(spark, sf_dir))


# ---------------------------------------------------------------- metrics


@query(f"""WITH ev AS ({O.EVENTS}), c AS (SELECT DISTINCT event_type AS class FROM events)
  SELECT a.class AS actual, p.class AS predicted,
    (SELECT count(*) FROM ev WHERE event_type = a.class AND rule_class = p.class) AS n FROM c a, c p""")
def confusion(spark, sf_dir):
    flows = standins.events_flows(spark, sf_dir)
    return metrics.confusion(metrics.pair_counts(flows, "event_type", "rule_class"), _event_classes(flows))


@query(f"SELECT round(avg(CAST(event_type = rule_class AS INTEGER)), 9) AS accuracy FROM ({O.EVENTS})")
def accuracy(spark, sf_dir):
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "event_type", "rule_class")
    return rounded(metrics.accuracy(pairs), ["accuracy"], 9)


@query(f"""WITH {BINARY_SQL} SELECT tn, fp, fn, tp, {O.rounded(['accuracy', 'precision', 'recall', 'f1', 'far'], 9)} FROM scores""")
def binary_metrics(spark, sf_dir):
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "is_attack", "rule")
    return rounded(metrics.binary_metrics(pairs), ["accuracy", "precision", "recall", "f1", "far"], 9)


@query(f"""WITH ev AS ({O.EVENTS}), {O.REPORT} SELECT class, {O.rounded(['precision', 'recall', 'f1'], 9)}, support FROM report""")
def classification_report(spark, sf_dir):
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "event_type", "rule_class")
    return rounded(metrics.class_report(pairs), ["precision", "recall", "f1"], 9)


@query(f"""WITH ev AS ({O.EVENTS}), {O.REPORT}
  SELECT 'macro avg' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
    round(avg(f1), 9) AS f1, CAST(sum(support) AS BIGINT) AS support FROM report
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
    round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
    CAST(sum(support) AS BIGINT) FROM report""")
def macro_weighted_averages(spark, sf_dir):
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "event_type", "rule_class")
    return rounded(metrics.averages(metrics.class_report(pairs)), ["precision", "recall", "f1"], 9)


@query(f"""WITH ev AS ({O.EVENTS}), {O.REPORT} SELECT round(1 - recall, 9) AS far FROM report WHERE class = 'view'""")
def false_alarm_rate(spark, sf_dir):
    """Alarms raised on benign rows; here views are the benign class."""
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "event_type", "rule_class")
    return rounded(metrics.false_alarm_rate(metrics.class_report(pairs), "view"), ["far"], 9)


@query(f"""WITH ev AS ({O.EVENTS}), {O.REPORT} SELECT class, {O.rounded(['precision', 'recall', 'f1'], 9)}, support
  FROM report WHERE class IN ('click', 'error')
  UNION ALL SELECT 'no such class', 0, 0, 0, 0""")
def restricted_report(spark, sf_dir):
    pairs = metrics.pair_counts(standins.events_flows(spark, sf_dir), "event_type", "rule_class")
    report = metrics.class_report(pairs, ["click", "error", "no such class"])
    return rounded(report, ["precision", "recall", "f1"], 9)


def _ap_sql(rows: str) -> str:
    return f"""counts AS (SELECT class, score, sum(hit) AS h, count(*) AS n FROM ({rows}) GROUP BY ALL),
  running AS (SELECT class, h, sum(h) OVER w AS tp, sum(n) OVER w AS called FROM counts
    WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
  per_class AS (SELECT class, coalesce(sum(h * tp / CAST(called AS DOUBLE)) / nullif(sum(h), 0), 0) AS average_precision,
    CAST(sum(h) AS BIGINT) AS positives FROM running GROUP BY class)"""


@query(f"""WITH ev AS ({O.EVENTS}), {_ap_sql("SELECT '' AS class, rule_score AS score, is_attack AS hit FROM ev")}
  SELECT round(average_precision, 9) AS average_precision, positives FROM per_class""")
def average_precision(spark, sf_dir):
    flows = standins.events_flows(spark, sf_dir)
    return rounded(metrics.average_precision(flows, "is_attack", "rule_score"), ["average_precision"], 9)


CLASS_SCORES = """SELECT c.class, CAST(event_type = c.class AS INTEGER) AS hit,
    (value * (length(c.class) + event_id % 3)) AS score FROM ev, (SELECT DISTINCT event_type AS class FROM events) c"""


def _class_scores(spark, sf_dir):
    flows = standins.events_flows(spark, sf_dir)
    names = _event_classes(flows)
    scores = F.array(*[F.col("value") * (len(c) + F.col("event_id") % 3) for c in names])
    return classes.long_scores(flows.withColumn("scores", scores), "event_type", "scores", names)


@query(f"""WITH ev AS ({O.EVENTS}), {_ap_sql(CLASS_SCORES)}
  SELECT class, round(average_precision, 9) AS average_precision, positives FROM per_class""")
def average_precision_per_class(spark, sf_dir):
    found = metrics.average_precision(_class_scores(spark, sf_dir), "hit", "score", "class")
    return rounded(found, ["average_precision"], 9)


@query(f"""WITH ev AS ({O.EVENTS}), {_ap_sql(CLASS_SCORES)}
  SELECT round(avg(average_precision), 9) AS macro_average_precision FROM per_class""")
def macro_average_precision(spark, sf_dir):
    found = metrics.macro_average_precision(_class_scores(spark, sf_dir), "class", "hit", "score")
    return rounded(found, ["macro_average_precision"], 9)


@query("""SELECT unnest(['fit_seconds', 'score_seconds']) AS metric, TRUE AS measured""")
def inference_seconds(spark, sf_dir):
    """Time to fit and to score the held-out rows; the score is forced, nothing is stored."""
    data = _shared_data(spark, sf_dir)
    model = fit_logistic(data.train, "is_attack", data.features)
    scored = model.predict(data.test)
    rows = metrics.constant_rows(
        spark, "lineitem", "logistic", TEST,
        {"fit_seconds": model.fit_seconds, "score_seconds": timed(scored)},
    )
    return rows.select("metric", (F.col("value") > 0).alias("measured"))


@query(f"""WITH {TAKEN}, base AS (SELECT * FROM placed WHERE o_orderstatus <> {TOP_STATUS} OR place <= 500)
  SELECT 'orders' AS experiment, 'base' AS model, 'train' AS split, o_orderstatus AS class, 'base_rows' AS metric,
    CAST(count(*) AS DOUBLE) AS value FROM base GROUP BY ALL
  UNION ALL SELECT 'orders', 'base', 'train', '', 'base_rows', CAST(count(*) AS DOUBLE) FROM base
  UNION ALL SELECT 'orders', 'base', 'train', '', 'rare_classes', 0""")
def experiment_metadata(spark, sf_dir):
    """Size and class distribution of a training base, and its rare classes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    base = balance.downsample(orders, "o_orderstatus", 500, ["o_orderkey"])
    sizes = classes.class_counts(base, "o_orderstatus").withColumnRenamed("n", "base_rows")
    total = sizes.agg(F.sum("base_rows").alias("base_rows"), F.count_if(F.col("base_rows") < 6).alias("rare_classes"))
    return metrics.metric_rows(sizes, "orders", "base", TRAIN, ["base_rows"], "o_orderstatus").unionByName(
        metrics.metric_rows(total, "orders", "base", TRAIN, ["base_rows", "rare_classes"])
    )


def _averages_sql(name: str, actual: str, predicted: str) -> str:
    """CTE ``name``: macro and weighted averages of a report over the classes that occur in ``ev``."""
    averages = ", ".join(
        [f"avg({m}) AS macro_{m}" for m in ("precision", "recall", "f1")]
        + [f"sum({m} * support) / sum(support) AS weighted_{m}" for m in ("precision", "recall", "f1")]
    )
    return f"""{name}_counts AS (SELECT class, CAST(count(*) FILTER (a = class) AS DOUBLE) AS support,
      CAST(count(*) FILTER (p = class) AS DOUBLE) AS called, CAST(count(*) FILTER (a = class AND p = class) AS DOUBLE) AS hits
    FROM (SELECT {actual} AS a, {predicted} AS p FROM ev), (SELECT {actual} AS class FROM ev UNION SELECT {predicted} FROM ev)
    GROUP BY class),
  {name}_pr AS (SELECT support, {O.ratio('hits', 'called')} AS precision, {O.ratio('hits', 'support')} AS recall FROM {name}_counts),
  {name} AS (SELECT {averages} FROM
    (SELECT *, {O.ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM {name}_pr))"""


ROUNDED_AVERAGES = ", ".join(f"round({m}, 9) AS {m}" for m in metrics.AVERAGES)


@query(f"""WITH {BINARY_SQL}, {_averages_sql("rule_avg", "is_attack", "rule")},
  {_averages_sql("class_avg", "event_type", "rule_class")}, ap AS (WITH {_ap_sql("SELECT '' AS class, rule_score AS score, is_attack AS hit FROM ev")}
    SELECT average_precision FROM per_class)
  SELECT 'events' AS experiment, 'rule' AS model, 'all' AS split, round(accuracy, 9) AS accuracy,
    round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(far, 9) AS far,
    round(average_precision, 9) AS auc_pr, {ROUNDED_AVERAGES} FROM scores, ap, rule_avg
  UNION ALL SELECT 'events', 'class rule', 'all', (SELECT round(avg(CAST(event_type = rule_class AS INTEGER)), 9) FROM ev),
    NULL, NULL, NULL, NULL, NULL, {ROUNDED_AVERAGES} FROM class_avg""")
def summary_pivot(spark, sf_dir):
    flows = standins.events_flows(spark, sf_dir)
    pairs = metrics.pair_counts(flows, "event_type", "rule_class")
    rows = metrics.union_all(
        [
            binary_rows(flows, "events", "rule", "all", "is_attack", "rule", "rule_score"),
            report_rows(pairs, "events", "class rule", "all"),
            metrics.metric_rows(metrics.accuracy(pairs), "events", "class rule", "all", ["accuracy"]),
        ]
    )
    names = ["accuracy", "precision", "recall", "f1", "far", "auc_pr"]
    return rounded(metrics.summary(rows, names), [*names, *metrics.AVERAGES], 9)


# ---------------------------------------------------------------- detector and cascade steps

SWEEP_SQL = """ev AS (SELECT -l_extendedprice AS score, CAST(l_returnflag = 'R' AS INTEGER) AS is_attack FROM lineitem),
  levels AS (SELECT unnest([0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) AS level,
    unnest((SELECT quantile_cont(score, [0.1, 0.15, 0.2]) FROM ev)) AS cutoff)"""


@query(f"""WITH {SWEEP_SQL} SELECT level, round(cutoff, 6) AS cutoff,
    count(*) FILTER (score < cutoff) AS flagged, count(*) FILTER (score < cutoff AND is_attack = 1) AS caught
  FROM ev, levels GROUP BY ALL""")
def anomaly_threshold_sweep(spark, sf_dir):
    """Three contamination levels from one pass over the scores."""
    scored = table(spark, sf_dir, "lineitem").select(
        (-F.col("l_extendedprice")).alias("score"), (F.col("l_returnflag") == "R").alias("attack")
    )
    levels = [0.10, 0.15, 0.20]
    cutoffs = quantiles(scored, ["score"], levels)["score"]
    entries = F.array(
        *[F.struct(F.lit(a).alias("level"), F.lit(c).alias("cutoff")) for a, c in zip(levels, cutoffs)]
    )
    flag = detector_code(F.col("score"), F.col("at.cutoff")) == -1
    return (
        scored.withColumn("at", F.explode(entries))
        .groupBy(F.col("at.level").alias("level"), F.round("at.cutoff", 6).alias("cutoff"))
        .agg(F.count_if(flag).alias("flagged"), F.count_if(flag & F.col("attack")).alias("caught"))
    )


@query(f"SELECT event_id, CASE WHEN -value < -60 THEN -1 ELSE 1 END AS code FROM ({O.EVENTS})")
def anomaly_codes(spark, sf_dir):
    flows = standins.events_flows(spark, sf_dir)
    return flows.select("event_id", detector_code(-F.col("value"), -60.0).alias("code"))


@query(f"SELECT event_id, CASE WHEN rule = 1 THEN rule_class ELSE 'view' END AS prediction FROM ({O.EVENTS})")
def cascade_combine(spark, sf_dir):
    flows = standins.events_flows(spark, sf_dir)
    final = combine(F.col("rule") == 1, F.col("rule_class"), "view")
    return flows.select("event_id", final.alias("prediction"))


@query(f"""SELECT count(*) AS rows, count(*) FILTER (rule = 1) AS flagged, count(*) FILTER (rule = 0) AS bypassed,
  round(avg(rule), 9) AS flagged_share, round(avg(1 - rule), 9) AS bypassed_share FROM ({O.EVENTS})""")
def cascade_routing(spark, sf_dir):
    routed = routing(standins.events_flows(spark, sf_dir), F.col("rule") == 1)
    return rounded(routed, ["flagged_share", "bypassed_share"], 9)


# ---------------------------------------------------------------- models

CLASS_SPLIT = O.split_ctes(
    f"""SELECT * EXCLUDE (is_attack), CASE WHEN duration > 80000 THEN 'bulk' WHEN duration > 60000 THEN 'dear'
      ELSE 'BENIGN' END AS label FROM ({O.LINEITEM_SHARED})""", "label", ", ".join(LINEITEM_KEY)
)
EVENTS_SPLIT = O.split_ctes(O.EVENTS_SHARED, "is_attack", "event_id")


def _shared_data(spark, sf_dir) -> prepare.Prepared:
    return prepare.fit_and_scale(
        standins.lineitem_shared(spark, sf_dir), "is_attack", ["is_attack"], LINEITEM_KEY
    )


def _class_data(spark, sf_dir) -> prepare.Prepared:
    """Three classes which follow from the features."""
    shared = standins.lineitem_shared(spark, sf_dir)
    size = F.col("duration")
    name = F.when(size > 80000, F.lit("bulk")).when(size > 60000, F.lit("dear")).otherwise(F.lit("BENIGN"))
    flows = shared.withColumn("label", name).drop("is_attack")
    return prepare.fit_and_scale(flows, "label", ["label"], LINEITEM_KEY)


def _isolation(data: prepare.Prepared) -> IsolationForest:
    train, order = data.hashed_train(LINEITEM_KEY)
    return IsolationForest.fit(train, data.features, LINEITEM_KEY, order=order)


def _binary_facts(model: Classifier, data: prepare.Prepared) -> DataFrame:
    """Held-out rows by actual label; the label follows from a feature, so it must be learned."""
    pairs = metrics.pair_counts(model.predict(data.test), "is_attack", "prediction")
    return metrics.binary_metrics(pairs).select(
        F.expr("tn + fp").alias("benign"), F.expr("fn + tp").alias("attacks"),
        (F.col("accuracy") > 0.95).alias("learned"),
    )


BINARY_FACTS = f"""WITH {TRANSFER_SPLIT} SELECT count(*) FILTER (is_attack = 0) AS benign,
  count(*) FILTER (is_attack = 1) AS attacks, TRUE AS learned FROM marked WHERE split = 'test'"""
CLASS_FACTS = f"""WITH {CLASS_SPLIT} SELECT label AS class, count(*) AS support, TRUE AS learned FROM marked
  WHERE split = 'test' GROUP BY ALL"""


@query(BINARY_FACTS)
def logistic_binary(spark, sf_dir):
    data = _shared_data(spark, sf_dir)
    return _binary_facts(fit_logistic(data.train, "is_attack", data.features), data)


@query(BINARY_FACTS)
def forest_binary(spark, sf_dir):
    data = _shared_data(spark, sf_dir)
    return _binary_facts(fit_forest(data.train, "is_attack", data.features), data)


def _class_facts(model: Classifier, data: prepare.Prepared) -> DataFrame:
    report = metrics.class_report(metrics.pair_counts(model.predict(data.test), "label", "prediction"))
    return report.select("class", "support", (F.col("f1") > 0.9).alias("learned"))


@query(CLASS_FACTS)
def boosted_weighted(spark, sf_dir):
    data = _class_data(spark, sf_dir)
    base = training_base(data, "label", key=LINEITEM_KEY)
    return _class_facts(fit_boosted(base, "label", data.features, balanced=True), data)


@query(CLASS_FACTS)
def boosted_smote(spark, sf_dir):
    """Boosted trees on all training rows, raised to equal class sizes."""
    data = _class_data(spark, sf_dir)
    base = training_base(data, "label", key=LINEITEM_KEY, base_rows=None)
    return _class_facts(fit_on_smote(base, "label", data.features, LINEITEM_KEY)[0], data)


@query(f"""WITH {TRANSFER_SPLIT} SELECT split, count(*) AS n, TRUE AS near_level FROM marked GROUP BY ALL""")
def isolation_fit_predict(spark, sf_dir):
    """Share of outliers at contamination 0.15: exact on training rows, close to it on held-out ones."""
    data = _shared_data(spark, sf_dir)
    forest = _isolation(data)
    # Training rows are scored once, for the threshold and for their codes.
    scored = stage(forest.score(data.table).select("split", "score"), "scored")
    offset = forest.offsets(scored.filter(F.col("split") == TRAIN), [0.15], scored="score")[0.15]
    flagged = scored.withColumn("code", detector_code(F.col("score"), offset)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("code") == -1).cast("int")).alias("share")
    )
    slack = F.when(F.col("split") == TRAIN, 0.005).otherwise(0.05)
    return flagged.select("split", "n", (F.abs(F.col("share") - 0.15) < slack).alias("near_level"))


@query(f"""WITH {CLASS_SPLIT} SELECT unnest(['isolation c=0.10', 'isolation c=0.15', 'isolation c=0.20']) AS model,
  (SELECT count(*) FROM marked WHERE split = 'test') AS n,
  (SELECT count(*) FROM marked WHERE split = 'test' AND label <> 'BENIGN') AS attacks, TRUE AS timed""")
def isolation_sweep(spark, sf_dir):
    data = _class_data(spark, sf_dir)
    rows = anomaly_sweep(data, "label", "lineitem", key=LINEITEM_KEY).rows.filter("class = '' AND model <> 'base'")
    cells = rows.groupBy("model").pivot("metric", ["tn", "fp", "fn", "tp", "fit_seconds", "score_seconds"]).agg(F.max("value"))
    return cells.select(
        "model", F.expr("cast(tn + fp + fn + tp AS bigint)").alias("n"), F.expr("cast(fn + tp AS bigint)").alias("attacks"),
        F.expr("fit_seconds > 0 AND score_seconds > 0").alias("timed"),
    )


@query(f"""WITH {TRANSFER_SPLIT} SELECT {', '.join(LINEITEM_KEY)}, TRUE AS valid FROM marked WHERE split = 'test'""")
def class_probabilities(spark, sf_dir):
    """Probabilities of every held-out row: they sum to one, and the class is the likelier one."""
    data = _shared_data(spark, sf_dir)
    model = fit_forest(data.train, "is_attack", data.features)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    called = F.get("scores", F.col("prediction").cast("int")) == F.array_max("scores")
    valid = (F.abs(total - 1) < 1e-9) & (F.array_min("scores") >= 0) & called
    return model.predict(data.test).select(*LINEITEM_KEY, valid.alias("valid"))


def flagship(spark, sf_dir) -> DataFrame:
    """Two-stage detection: metric rows of the cascade on held-out flows."""
    data = _class_data(spark, sf_dir)
    base = training_base(data, "label", key=LINEITEM_KEY)
    second, _ = fit_on_smote(base, "label", data.features, LINEITEM_KEY)
    forest = _isolation(data)
    forest = forest.with_offset(forest.offsets(data.train, [0.15])[0.15])
    return cascade(data, "label", "lineitem", forest, second, L.BENIGN).rows


@query(f"""WITH {CLASS_SPLIT} SELECT label AS class, 'support' AS metric, CAST(count(*) AS DOUBLE) AS value FROM marked
    WHERE split = 'test' GROUP BY ALL
  UNION ALL SELECT '', 'rows', count(*) FROM marked WHERE split = 'test'
  UNION ALL SELECT '', 'flagged + bypassed', count(*) FROM marked WHERE split = 'test'""")
def cascade_models(spark, sf_dir):
    """Supports of the final classes, and that every row takes one of the two ways."""
    rows = flagship(spark, sf_dir).select("class", "metric", "value")
    routed = rows.filter("metric IN ('flagged', 'bypassed')").agg(F.sum("value").alias("value"))
    kept = rows.filter("metric = 'rows' OR (metric = 'support' AND class NOT LIKE '% avg')")
    return kept.unionByName(routed.select(F.lit("").alias("class"), F.lit("flagged + bypassed").alias("metric"), "value"))


def _part_sizes(rows: DataFrame) -> DataFrame:
    cells = rows.filter("class = ''").groupBy("experiment", "model", "split").pivot("metric", ["tn", "fp", "fn", "tp", "fit_seconds"]).agg(F.max("value"))
    return cells.select(
        "experiment", "model", "split", F.expr("cast(tn + fp + fn + tp AS bigint)").alias("n"),
        F.expr("cast(fn + tp AS bigint)").alias("attacks"), F.expr("fit_seconds > 0").alias("timed"),
    )


@query(f"""WITH here AS (WITH {TRANSFER_SPLIT} SELECT is_attack, split FROM marked),
    there AS (WITH {EVENTS_SPLIT} SELECT is_attack, split FROM marked),
    parts AS (SELECT 'lineitem to events' AS experiment, 'validation' AS split, is_attack FROM here WHERE split = 'test'
      UNION ALL SELECT 'lineitem to events', 'external', is_attack FROM there
      UNION ALL SELECT 'events to lineitem', 'validation', is_attack FROM there WHERE split = 'test'
      UNION ALL SELECT 'events to lineitem', 'external', is_attack FROM here)
  SELECT experiment, 'forest' AS model, split, count(*) AS n, count(*) FILTER (is_attack = 1) AS attacks, TRUE AS timed
  FROM parts GROUP BY ALL""")
def transfer_both_ways(spark, sf_dir):
    items = standins.lineitem_shared(spark, sf_dir)
    events = standins.events_shared(spark, sf_dir)
    there = transfer(items, events, "lineitem to events", key=LINEITEM_KEY)
    back = transfer(events, items, "events to lineitem", key=["event_id"])
    return _part_sizes(there.rows.unionByName(back.rows))


@query(f"""WITH {TRANSFER_SPLIT} SELECT 'lineitem' AS experiment, unnest(['logistic', 'forest']) AS model, 'test' AS split,
  (SELECT count(*) FROM marked WHERE split = 'test') AS n,
  (SELECT count(*) FROM marked WHERE split = 'test' AND is_attack = 1) AS attacks, TRUE AS timed""")
def binary_experiment(spark, sf_dir):
    return _part_sizes(binary_baselines(_shared_data(spark, sf_dir), "is_attack", "lineitem").rows)


@query(f"""WITH {CLASS_SPLIT}, held AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM marked WHERE split = 'test' GROUP BY ALL),
    reduced AS (SELECT label, least(count(*), CASE WHEN label = 'BENIGN' THEN 100000 ELSE count(*) END) AS n
      FROM marked WHERE split = 'train' GROUP BY label)
  SELECT m.model, 'test' AS split, label AS class, 'support' AS metric, n AS value
    FROM held, (SELECT unnest(['weighted', 'smote']) AS model) m
  UNION ALL SELECT 'base', 'train', label, 'base_rows', n FROM reduced
  UNION ALL SELECT 'base', 'train', '', 'base_rows', sum(n) FROM reduced
  UNION ALL SELECT 'base', 'train', '', 'rare_classes', count(*) FILTER (n < 6) FROM reduced
  UNION ALL SELECT 'base', 'train', label, 'dropped', 1 FROM reduced WHERE n < 6""")
def multiclass_experiment(spark, sf_dir):
    """Supports of both models, the size of the training base, and the classes it drops."""
    rows = multiclass(_class_data(spark, sf_dir), "label", "lineitem", L.BENIGN, key=LINEITEM_KEY).rows
    facts = "model = 'base' OR (metric = 'support' AND class NOT LIKE '% avg')"
    return rows.filter(facts).select("model", "split", "class", "metric", "value")


HELD_OUT_SQL = f"""WITH {O.split_ctes(O.EVENTS, 'is_attack', 'event_id')},
  {O.scaled_ctes(['value', 'k'], ['event_id', 'split', 'is_attack'])},
  ev AS (SELECT is_attack, CAST(value > 0.5 AS INTEGER) AS rule FROM scaled WHERE split = 'test'),
  cells AS ({O.BINARY_CELLS}),
  pr AS (SELECT *, {O.ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {O.ratio('tp', 'tp + fp')} AS precision,
    {O.ratio('tp', 'tp + fn')} AS recall, {O.ratio('fp', 'fp + tn')} AS far FROM cells)
  SELECT tn, fp, fn, tp, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
    round({O.ratio('2 * precision * recall', 'precision + recall')}, 9) AS f1, round(far, 9) AS far FROM pr"""


@query(HELD_OUT_SQL)
def held_out_detection(spark, sf_dir):
    """How good is a detector on held-out flows? Split, fit on training rows, scale, judge."""
    flows = standins.events_flows(spark, sf_dir).select("event_id", "value", "k", "is_attack")
    marked = stratified_split(flows, "is_attack", ["event_id"])
    fitted = prep.FeaturePrep.fit(marked.filter(F.col("split") == TRAIN), ["value", "k"])
    held_out = fitted.transform(marked.filter(F.col("split") == TEST))
    called = held_out.withColumn("rule", (F.col("value") > 0.5).cast("int"))
    scores = metrics.binary_metrics(metrics.pair_counts(called, "is_attack", "rule"))
    return rounded(scores, ["accuracy", "precision", "recall", "f1", "far"], 9)
