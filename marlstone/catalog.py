"""Queries over the driver's tables, by name, and the SQL that states the same.

The engine's own data are script trees; these queries apply its operators to
tables that have the same shape.  Ordered results carry an explicit rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions import requirements, scalars
from .operators import blocks, graph, report
from .plans import trees
from .sources import files, script, versions

# The closed list that stands for languages, in its order.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: The active languages, by their command-line names, and the file code of each language of ``documents``.
ACTIVE = ["german", "english", "french"]
CODES = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References (key) and missing keys: customers by order priority."""
    orders = _table(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_custkey").cast("string").alias("key")).distinct()
    dimension = spark.createDataFrame(list(enumerate(PRIORITIES)), "ord int, lang string")
    present = orders.select(F.col("o_orderpriority").alias("lang"), F.col("o_custkey").cast("string").alias("key")).distinct()
    return refs, report.missing(refs, dimension, present)


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)[1]


def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(*_orders(spark, sf_dir))


def missing_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(_orders(spark, sf_dir)[1]).select("rank", "key", "absent")


_MISSING = f"""
with d(ord, lang) as (values {", ".join(f"({i}, '{p}')" for i, p in enumerate(PRIORITIES))}),
refs as (select distinct o_custkey::varchar as key from orders),
present as (select distinct o_orderpriority as lang, o_custkey::varchar as key from orders),
gone as (select r.key, string_agg(d.lang, ', ' order by d.ord) as absent from refs r cross join d
         where not exists (select 1 from present p where p.lang = d.lang and p.key = r.key) group by r.key)
"""


def missing_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a name that nothing has, which every key lacks; how many keys lack what."""
    orders = _table(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_custkey").cast("string").alias("key")).distinct()
    dimension = spark.createDataFrame([(-1, "0-NONE"), *enumerate(PRIORITIES)], "ord int, lang string")
    present = orders.select(F.col("o_orderpriority").alias("lang"), F.col("o_custkey").cast("string").alias("key")).distinct()
    return report.missing(refs, dimension, present).groupBy("absent").agg(F.count("*").alias("n"))


def _localisation(docs: DataFrame) -> DataFrame:
    """A localisation file for each document (name, text), marked with its language."""
    code = F.element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), F.col("lang"))
    return files.with_names(docs.select(F.concat(F.lit("localisation/"), F.col("name"), F.lit("_l_"), code, F.lit(".yml")).alias("path"), "text"))


def language_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (lang, key) of the active languages: a file for each document, with its source as the key."""
    docs = _table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("header\n "), "source", F.lit(':0 "x"\n')).alias("text"))
    return files.load_keys(files.active_files(_localisation(docs), files.active(spark, ACTIVE)))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each brand in natural order; a few brands, so one window is enough."""
    brands = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    return brands.select("brand", F.row_number().over(Window.orderBy(scalars.natural_key(F.col("brand")), "brand")).alias("rank"))


def byte_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second occurrence of a word, in bytes."""
    t, key = F.coalesce("text", F.lit("")), F.lit(" de ")
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.byte_offset(t, key).alias("first_at"), scalars.second_byte_offset(t, key).alias("second_at"))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all lines but the first of the texts, as of localisation files, counted by language."""
    docs = _table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("name"), "text")
    keys = files.load_keys(_localisation(docs))
    return keys.groupBy("lang").agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def first_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each link the least (page, byte offset) that has it."""
    pages = _table(spark, sf_dir, "pages").select("url", "html")
    refs = pages.select("url", "html", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("key"))
    return report.first_refs(refs.select("key", F.col("url").alias("path"), scalars.byte_offset(F.col("html"), F.col("key")).alias("offset")))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a key after its first row, in order of part and supplier."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return report.nth_of(rows, ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")).filter("nth > 1")


def nested_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested field by its path; rows without it are left out."""
    found = _table(spark, sf_dir, "events").select("event_type", scalars.nested(F.col("props"), "k").try_cast("long").alias("k")).filter("k is not null")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_distinct("k").alias("n_distinct"))


def edge_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a turn to the one two later whose ends both are the user's, within a conversation."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("id"), "role")
    edges = turns.select("group_id", F.col("id").alias("src"), (F.col("id") + 2).alias("dst")).distinct()
    return graph.inner_edges(turns.filter("role = 'user'"), edges).select("group_id", "src", "dst")


def _order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph for each order: its parts, by their first line, and an edge to each higher part that was shipped later."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("id"), "l_linenumber", "l_shipdate")
    rows = lines.groupBy("group_id", "id").agg(F.min("l_linenumber").alias("line"), F.min("l_shipdate").alias("shipped"))
    nodes = rows.select("group_id", "id", F.row_number().over(Window.partitionBy("group_id").orderBy("line", "id")).alias("idx"))
    ends = rows.select("group_id", "id", "shipped")
    edges = ends.toDF("group_id", "src", "at").join(ends.toDF("group_id", "dst", "later"), "group_id").filter("src < dst and at < later").select("group_id", "src", "dst")
    return nodes, edges


def stable_toposort(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = graph.toposort(*_order_graph(spark, sf_dir)).filter("ok")
    return done.select("group_id", "id", "rank", "component")


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degrees(_order_graph(spark, sf_dir)[1])


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected parts of each order's graph, named by their first node, with their size."""
    done = graph.toposort(*_order_graph(spark, sf_dir)).filter("ok")
    return done.groupBy("group_id", "component").agg(F.count("*").alias("n_nodes"))


def cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose graph has a cycle, after an edge back from the highest part to the lowest."""
    nodes, edges = _order_graph(spark, sf_dir)
    ends = nodes.groupBy("group_id").agg(F.max("id").alias("src"), F.min("id").alias("dst"))
    return graph.toposort(nodes, edges.unionByName(ends)).filter("not ok").select("group_id")


_GRAPH = """
with recursive rows_ as (select l_orderkey as g, l_partkey as id, min(l_linenumber) as line, min(l_shipdate) as shipped from lineitem group by all),
n as (select g, id, shipped, row_number() over (partition by g order by line, id) as idx from rows_),
e as (select a.g, a.idx as src, b.idx as dst, a.id as src_id, b.id as dst_id from n a join n b on a.g = b.g and a.id < b.id and a.shipped < b.shipped),
both_ as (select g, src as x, dst as y from e union select g, dst, src from e),
reach(g, x, y) as (select g, idx, idx from n union select r.g, r.x, b.y from reach r join both_ b on b.g = r.g and b.x = r.y),
comp as (select g, x as idx, min(y) as c from reach group by g, x),
"""


def max_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest version by type of part; names that are none are left out."""
    part = _table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 7 == 0, F.lit("none")).otherwise(F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 23).cast("string"), F.col("p_size").cast("string"), F.lit("0")))
    return versions.latest(part.select("p_type", name.alias("name")), by=("p_type",))


def version_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts' versions meet a requirement of their type."""
    part = _table(spark, sf_dir, "part")
    version = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 5).cast("string"), (F.col("p_size") % 3).cast("string"))
    wants = F.element_at(F.array(*map(F.lit, ("1.*", "~2.3", "^1.2.1", ">=1.2, <3"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = part.select("p_partkey", wants.alias("requirement"), version.alias("version"))
    return rows.withColumn("met", requirements.requirement_matches(F.col("requirement"), F.col("version")))


#: Paths of files, by size and brand of a part.
FOLDERS = ("events", "common/national_focus", "common/technologies", "backup/events", "localisation/english")
NAMES = ("a_l_english.yml", "b.c_l_german.yml", "_hidden.txt", "final_l_braz_por.txt", ".x_l_simp_chinese", "l_l_french.a.b", "l_klingon.yml")


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, language and prefix of each file: a language mark goes before the folder, folders count from the root."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    part = _table(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    path = F.concat(pick(FOLDERS, F.col("p_size") % len(FOLDERS)), F.lit("/"), pick(NAMES, number % len(NAMES)))
    routed = files.routed(files.with_names(part.select("p_partkey", path.alias("path"))))
    return routed.select("p_partkey", "path", "route", "lang", "prefix")


def comma_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(F.floor("o_totalprice")).alias("total"))
    return total.select("o_orderpriority", scalars.with_commas(F.col("total")).alias("total"))


def repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's values as JSON: a list only if there are several."""
    rows = _table(spark, sf_dir, "conversations").select(F.lit("").alias("parent"), F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("ord"), F.col("role").alias("value"))
    return versions.folded_values(rows).select("key", "json")


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-values text of each conversation, read to JSON: a role with several turns becomes a list."""
    line = F.concat(F.lit('"'), "role", F.lit('" "'), F.col("turn").cast("string"), F.lit('"'))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit('"c" { '), F.array_join(F.transform("lines", lambda x: x["line"]), " "), F.lit(' "n" { } }'))
    return rows.select("conv_id", versions.as_json(text).alias("json"))


_KEYWORDS = ("country_event", "news_event")


def _spread(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Parsing costs far more than the texts' bytes tell, so they aren't left in the few tasks that bytes ask for."""
    return texts.repartition(spark.sparkContext.defaultParallelism, "path")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each customer: a block for each order, by date, that names the order before it by number."""
    orders = _table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, _KEYWORDS[0]).otherwise(_KEYWORDS[1])
    block = F.concat(kind, F.lit(" = {\n\tid = o."), F.col("o_orderkey").cast("string"), F.lit("\n\ttitle = o."), F.col("o_orderkey").cast("string"), F.lit(".t\n}\n"))
    rows = orders.select("o_custkey", F.struct("o_orderdate", "o_orderkey", block.alias("block")).alias("b"))
    texts = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["block"]), "\n").alias("text"))
    return _spread(spark, texts.select(F.concat(F.lit("events/"), F.col("o_custkey").cast("string")).alias("path"), "text"))


def script_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of the parsed scripts, counted by path of keys."""
    nodes = script.nodes(_scripts(spark, sf_dir)).filter("kind = 'scalar'")
    return nodes.groupBy(F.array_join("key_path", "/").alias("keys")).agg(F.count("*").alias("n"), F.count_distinct("scalar").alias("n_values"))


def block_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts with their blocks in natural order of the ids, and whether that changed them."""
    files = _scripts(spark, sf_dir)
    ids = script.nodes(files).filter("kind = 'scalar' and key = 'id' and depth = 1").select("path", "scalar")
    ordered = ids.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(scalars.natural_key(F.col("scalar")).alias("k"), "scalar"))), lambda x: x["scalar"]).alias("ids"))
    out = files.join(ordered, "path").withColumn("new_text", blocks.rewritten(F.col("text"), F.col("ids"), _KEYWORDS))
    return out.select("path", F.md5("new_text").alias("digest"), (F.col("new_text") != F.col("text")).alias("changed"))


def drift_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_reorder(spark, sf_dir).agg(F.bool_or("changed").alias("drift"), F.sum(F.col("changed").cast("long")).alias("n_changed"))


_SCRIPTS = """
with b as (select o_custkey, o_orderdate, o_orderkey,
  case when o_orderkey % 2 = 0 then 'country_event' else 'news_event' end || ' = {' || chr(10) || chr(9) || 'id = o.' || o_orderkey || chr(10)
  || chr(9) || 'title = o.' || o_orderkey || '.t' || chr(10) || '}' || chr(10) as block from orders),
t as (select 'events/' || o_custkey as path, string_agg(block, chr(10) order by o_orderdate, o_orderkey) as before,
             string_agg(block, chr(10) order by o_orderkey) as after from b group by o_custkey)
"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of scripts: events by customer, focuses by nation, technologies by region, and a file that is out of scope.

    An event stands for an order, in order of their numbers, and triggers the one that is next by date.
    A focus stands for a supplier, in order of the balance; it needs the one before it by number, and lies relative to the nation's first.
    """
    orders = _table(spark, sf_dir, "orders").filter("o_custkey is not null")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = lambda k: F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("."), k.cast("string"))
    own, following = name(F.col("o_orderkey")), name(F.lead("o_orderkey").over(by_date))
    trigger = F.concat(F.lit("\timmediate = { if = { news_event = { id = "), following, F.lit(" country_event = c.0 } } }\n"))
    kind = F.when(F.col("o_orderstatus") == "F", F.lit(_KEYWORDS[0])).otherwise(F.lit(_KEYWORDS[1]))
    event = F.concat(kind, F.lit(" = {\n\tid = "), own, F.lit("\n\ttitle = "), own, F.lit(".t\n\tdesc = { text = no }\n\toption = {\n\t\tname = "), own, F.lit(".a\n\t}\n"), F.coalesce(trigger, F.lit("")), F.lit("}\n"))
    joined = lambda order, block, gap: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, block.alias("block")))), lambda x: x["block"]), gap)
    events = orders.select("o_custkey", "o_orderkey", event.alias("event")).groupBy("o_custkey").agg(joined(["o_orderkey"], F.col("event"), "\n").alias("text"))
    events = events.select(F.concat(F.lit("events/c"), F.col("o_custkey").cast("string"), F.lit(".txt")).alias("path"), "text")

    by_number = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = lambda k: F.concat(F.lit("s"), k.cast("string"))
    before, first = F.lag("s_suppkey").over(by_number), F.first("s_suppkey").over(by_number)
    need = F.concat(F.lit("\t\tprerequisite = { focus = "), s(before), F.lit(" }\n\t\trelative_position_id = "), s(first), F.lit("\n"))
    focus = F.concat(F.lit("\tfocus = {\n\t\tid = "), s(F.col("s_suppkey")), F.lit("\n"), F.coalesce(need, F.lit("")), F.lit("\t}\n"))
    focuses = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey", focus.alias("focus")).groupBy("s_nationkey").agg(joined(["s_acctbal", "s_suppkey"], F.col("focus"), "\n").alias("text"))
    text = F.concat(F.lit("focus_tree = {\n"), "text", F.lit("}\n"))
    # Half of the files have the other line ends.
    text = F.when(F.col("s_nationkey") < 12, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    focuses = focuses.select(F.concat(F.lit("common/national_focus/n"), F.col("s_nationkey").cast("string"), F.lit(".txt")).alias("path"), text.alias("text"))

    technology = F.concat(F.lit("\t"), "n_name", F.lit(" = { x = 1 }\n"))
    technologies = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(joined(["n_nationkey"], technology, "").alias("text"))
    technologies = technologies.select(F.concat(F.lit("common/technologies/r"), F.col("n_regionkey").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("technologies = {\n\t@v = 1\n"), "text", F.lit("}\n")).alias("text"))
    outside = spark.createDataFrame([("backup/events/x.txt", "country_event = {\n\ttitle = out.of.scope\n}\n")], "path string, text string")
    return files.with_names(_spread(spark, events.unionByName(focuses).unionByName(technologies).unionByName(outside)))


def tree_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of events, ids of focuses and names of technologies, with the first place of each."""
    return trees.references(_tree(spark, sf_dir))


def focus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between focuses of a tree, parallel ones counted."""
    edges = trees.focus_edges(_tree(spark, sf_dir))
    return edges.groupBy(F.concat("path", F.lit("#"), F.col("tree").cast("string")).alias("group_id"), "src", "dst").agg(F.count("*").alias("n"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers between events of a file, with the natural place of both ends."""
    return trees.event_edges(_tree(spark, sf_dir)).withColumnRenamed("path", "group_id")


def tree_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All focus and event files with their blocks in graph order."""
    return trees.rewrites(_tree(spark, sf_dir)).select("path", "kind", F.md5("new_text").alias("digest"), "changed")


def descriptor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys and unmet requirements of a descriptor for each nation, whose fields are its customers."""
    customer = _table(spark, sf_dir, "customer")
    key = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("replace_path")).otherwise(F.lower("c_mktsegment"))
    line = F.concat(key, F.lit(" = "), F.col("c_custkey").cast("string"), F.lit("\n"))
    lines = customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "").alias("text"))
    head = F.concat(F.lit('supported_version = "1.'), (F.col("c_nationkey") % 5).cast("string"), F.lit('.*"\n'))
    own = lines.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/descriptor.mod")).alias("path"), F.concat(head, "text").alias("text"))
    names = _table(spark, sf_dir, "nation").select(F.concat_ws(".", F.lit("1"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("name"))
    return trees.check_descriptor(own, names).select("kind", "key", "detail", "path", "offset", "length", "rank")


_TREE = """
with o as (select o_custkey as c, o_orderkey as k, o_orderdate as d, case when o_orderstatus = 'F' then 'country_event' else 'news_event' end as kind,
             lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as following from orders where o_custkey is not null),
ev as (select c, k, d, following, 'events/c' || c || '.txt' as path, kind || ' = {' || chr(10) || chr(9) || 'id = c' || c || '.' || k || chr(10) || chr(9) || 'title = c' || c || '.' || k || '.t' || chr(10)
         || chr(9) || 'desc = { text = no }' || chr(10) || chr(9) || 'option = {' || chr(10) || chr(9) || chr(9) || 'name = c' || c || '.' || k || '.a' || chr(10) || chr(9) || '}' || chr(10)
         || coalesce(chr(9) || 'immediate = { if = { news_event = { id = c' || c || '.' || following || ' country_event = c.0 } } }' || chr(10), '') || '}' || chr(10) as block from o),
et as (select path, string_agg(block, chr(10) order by k) as text, string_agg(block, chr(10) order by d, k) as after from ev group by path),
s as (select s_nationkey as n, s_suppkey as k, s_acctbal as b, lag(s_suppkey) over w as before, first_value(s_suppkey) over w as first_ from supplier window w as (partition by s_nationkey order by s_suppkey)),
fo as (select n, k, b, before, first_, 'common/national_focus/n' || n || '.txt' as path, chr(9) || 'focus = {' || chr(10) || chr(9) || chr(9) || 'id = s' || k || chr(10)
         || coalesce(chr(9) || chr(9) || 'prerequisite = { focus = s' || before || ' }' || chr(10) || chr(9) || chr(9) || 'relative_position_id = s' || first_ || chr(10), '') || chr(9) || '}' || chr(10) as block from s),
f0 as (select path, n, 'focus_tree = {' || chr(10) || string_agg(block, chr(10) order by b, k) || '}' || chr(10) as text, 'focus_tree = {' || chr(10) || string_agg(block, chr(10) order by k) || '}' || chr(10) as after from fo group by path, n),
ft as (select path, case when n < 12 then replace(text, chr(10), chr(13) || chr(10)) else text end as text, case when n < 12 then replace(after, chr(10), chr(13) || chr(10)) else after end as after from f0),
tt as (select 'common/technologies/r' || n_regionkey || '.txt' as path, n_regionkey as r, 'technologies = {' || chr(10) || chr(9) || '@v = 1' || chr(10) || string_agg(chr(9) || n_name || ' = { x = 1 }' || chr(10), '' order by n_nationkey) || '}' || chr(10) as text from nation group by n_regionkey)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (missing_keys, missing_summary, missing_top10, missing_unused, language_keys, natural_sort, byte_offset, line_keys, first_ref, duplicate_rows, nested_project, edge_semi, stable_toposort, in_degree, components, cycle_groups, max_version, version_match, route_files, comma_format, repeated_values, key_values, script_nodes, block_reorder, drift_flag, tree_references, focus_edges, event_edges, tree_rewrites, descriptor_checks)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    code = "case lang " + " ".join(f"when '{x}' then '{y}'" for x, y in CODES.items()) + " end"
    named = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
    return {
        "missing_keys": _MISSING + "select key, absent from gone",
        "missing_summary": _MISSING + f"select (select count(*) from gone) as missing, (select count(*) from refs) as total, greatest((select count(*) from gone) - {report.SHOWN}, 0)::bigint as hidden, 'Found ' || format('{{:,}}', (select count(*) from gone)) || '/' || format('{{:,}}', (select count(*) from refs)) as line",
        "missing_top10": _MISSING + f"select (row_number() over (order by key))::int as rank, key, absent from gone order by key limit {report.SHOWN}",
        "missing_unused": "with d(ord, lang) as (values (-1, '0-NONE'), " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PRIORITIES)) + "), r as (select distinct o_custkey as k from orders), g as (select r.k, string_agg(d.lang, ', ' order by d.ord) as absent from r cross join d where not exists (select 1 from orders o where o.o_custkey = r.k and o.o_orderpriority = d.lang) group by r.k) select absent, count(*) as n from g group by absent",
        "language_keys": f"select distinct lang, key from (select {code} as lang, source as key from documents) where list_contains({named(ACTIVE)}, lang)",
        "natural_sort": "select brand, (row_number() over (order by regexp_extract(brand, '^([^0-9]*)', 1), regexp_extract(brand, '([0-9]+)', 1)::bigint, brand))::int as rank from (select distinct p_brand as brand from part)",
        "byte_offset": "with t as (select doc_id, coalesce(text, '') as t, instr(coalesce(text, ''), ' de ') as p from documents), u as (select *, instr(substr(t, p + 4), ' de ') as q from t) select doc_id, case when p > 0 then strlen(substr(t, 1, p - 1)) else 0 end::bigint as first_at, case when p > 0 and q > 0 then strlen(substr(t, 1, p + q + 2)) when p > 0 then strlen(substr(t, 1, p - 1)) else 0 end::bigint as second_at from u",
        "line_keys": f"with l as (select {code} as lang, string_split(text, chr(10)) as ls from documents where text is not null), i as (select lang, ls, unnest(range(2, len(ls) + 1)) as nr from l), t as (select lang, regexp_replace(ls[nr] || case when nr < len(ls) then chr(10) else '' end, '^\\s+', '') as line from i), k as (select distinct lang, split_part(line, ':', 1) as key from t where lang is not null) select lang, count(*) as n_keys, min(key) as first_key, max(key) as last_key from k where key <> '' group by lang",
        "first_ref": "with r as (select url, html, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) as key from pages), o as (select key, url as path, strlen(substr(html, 1, instr(html, key) - 1))::bigint as \"offset\" from r) select key, path, \"offset\" from o qualify row_number() over (partition by key order by path, \"offset\") = 1",
        "duplicate_rows": "select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey))::int as nth from lineitem) where nth > 1",
        "nested_project": "with k as (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) select event_type, count(*) as n, sum(k)::bigint as total, count(distinct k) as n_distinct from k where k is not null group by event_type",
        "edge_semi": "with t as (select distinct conv_id as g, turn as id, role from conversations) select a.g as group_id, a.id as src, a.id + 2 as dst from t a where a.role = 'user' and exists (select 1 from t b where b.g = a.g and b.id = a.id + 2 and b.role = 'user')",
        "stable_toposort": _GRAPH
        + """p as (select n.g, n.idx, n.id, c.c, coalesce((select list(e.src) from e where e.g = n.g and e.dst = n.idx), []) as preds from n join comp c on c.g = n.g and c.idx = n.idx),
r(g, step, em) as (select distinct g, 0, []::bigint[] from n union all
  select r.g, r.step + 1, list_append(any_value(r.em), arg_min(p.idx, p.c * 100000 + p.idx)) from r join p on p.g = r.g and not list_contains(r.em, p.idx) and list_has_all(r.em, p.preds) group by r.g, r.step),
last_ as (select g, arg_max(em, step) as em from r group by g),
o as (select g, unnest(em) as idx, (generate_subscripts(em, 1) - 1)::int as rank from last_)
select o.g as group_id, n.id, o.rank, m.id as component from o join n on n.g = o.g and n.idx = o.idx join comp c on c.g = o.g and c.idx = o.idx join n m on m.g = o.g and m.idx = c.c""",
        "in_degree": _GRAPH + "z as (select 1) select g as group_id, dst_id as id, count(*) as degree from e group by g, dst_id",
        "components": _GRAPH + "z as (select 1) select c.g as group_id, m.id as component, count(*) as n_nodes from comp c join n m on m.g = c.g and m.idx = c.c group by c.g, m.id",
        "cycle_groups": _GRAPH
        + """ends as (select g, max(id) as hi, min(id) as lo from n group by g),
down(g, id) as (select g, lo from ends union select d.g, e.dst_id from down d join e on e.g = d.g and e.src_id = d.id)
select distinct d.g as group_id from down d join ends x on x.g = d.g and x.hi = d.id""",
        "max_version": "with v as (select p_type, p_size % 5 as a, p_partkey % 23 as b, p_size as c from part where p_size % 7 <> 0) select p_type, a || '.' || b || '.' || c as version from v qualify row_number() over (partition by p_type order by a desc, b desc, c desc) = 1",
        "version_match": "with v as (select p_partkey, p_partkey % 4 as w, p_size % 4 as a, p_partkey % 5 as b, p_size % 3 as c from part) select p_partkey, case w when 0 then '1.*' when 1 then '~2.3' when 2 then '^1.2.1' else '>=1.2, <3' end as requirement, a || '.' || b || '.' || c as version, case w when 0 then a = 1 when 1 then a = 2 and b = 3 when 2 then a = 1 and (b > 2 or b = 2 and c >= 1) else (a > 1 or a = 1 and b >= 2) and a < 3 end as met from v",
        "route_files": f"with p as (select p_partkey, {named(FOLDERS)}[p_size % {len(FOLDERS)} + 1] as folder, {named(NAMES)}[regexp_extract(p_brand, '([0-9]+)', 1)::bigint % {len(NAMES)} + 1] as name from part), f as (select *, regexp_extract(name, '^(\\.?[^.]*)', 1) as prefix from p), m as (select *, case when regexp_extract(prefix, '^.*l_(.*)$', 1) in ('english', 'german', 'french', 'spanish', 'braz_por', 'simp_chinese') then regexp_extract(prefix, '^.*l_(.*)$', 1) end as lang from f) select p_partkey, folder || '/' || name as path, case when lang is not null then 'localisation' else case folder when 'events' then 'events' when 'common/national_focus' then 'national_focus' when 'common/technologies' then 'technologies' end end as route, lang, prefix from m",
        "comma_format": "select o_orderpriority, format('{:,}', sum(floor(o_totalprice))::bigint) as total from orders group by o_orderpriority",
        "repeated_values": "with g as (select conv_id::varchar as key, list(role order by turn, role) as v from conversations group by conv_id) select key, case when len(v) = 1 then '{\"v\":\"' || v[1] || '\"}' else '{\"v\":[' || list_aggregate(list_transform(v, lambda x: '\"' || x || '\"'), 'string_agg', ',') || ']}' end as json from g",
        "key_values": "with r as (select conv_id, role, list('\"' || turn || '\"' order by turn) as v, min(turn) as t0 from conversations group by conv_id, role) select conv_id, '{\"c\":{' || string_agg('\"' || role || '\":' || case when len(v) = 1 then v[1] else '[' || list_aggregate(v, 'string_agg', ',') || ']' end, ',' order by t0) || ',\"n\":{}}}' as json from r group by conv_id",
        "script_nodes": "with b as (select case when o_orderkey % 2 = 0 then 'country_event' else 'news_event' end as k, o_orderkey from orders), f as (select k, unnest(['id', 'title']) as f, o_orderkey from b) select k || '/' || f as keys, count(*) as n, count(distinct o_orderkey) as n_values from f group by k, f",
        "block_reorder": _SCRIPTS + "select path, md5(after) as digest, before <> after as changed from t",
        "tree_references": _TREE
        + """, r as (select 'c' || c || '.' || k || '.' || x as key, ev.path, et.text from ev join et using (path) cross join (values ('t'), ('a')) v(x)
  union all select 's' || k, fo.path, ft.text from fo join ft using (path) union all select n_name, tt.path, tt.text from nation join tt on tt.r = n_regionkey)
select key, path, (strlen(substr(text, 1, instr(text, key) - 1)))::bigint as "offset" from r qualify row_number() over (partition by key order by path, "offset") = 1""",
        "focus_edges": _TREE + "select path || '#0' as group_id, 's' || x as src, 's' || k as dst, count(*) as n from (select path, k, unnest([before, first_]) as x from fo where before is not null) group by all",
        "event_edges": _TREE
        + """, at_ as (select path, k, (row_number() over (partition by path order by k))::int as p from ev)
select ev.path as group_id, 'c' || ev.c || '.' || ev.k as src, 'c' || ev.c || '.' || ev.following as dst, a.p as src_at, b.p as dst_at from ev join at_ a on a.path = ev.path and a.k = ev.k join at_ b on b.path = ev.path and b.k = ev.following""",
        "tree_rewrites": _TREE + "select path, 'events' as kind, md5(after) as digest, text <> after as changed from et union all select path, 'focus', md5(after), text <> after from ft",
        "descriptor_checks": """
with l as (select c_nationkey as n, c_custkey as k, case when c_mktsegment = 'FURNITURE' then 'replace_path' else lower(c_mktsegment) end as key from customer),
t as (select n, 'n' || n || '/descriptor.mod' as path, 'supported_version = "1.' || n % 5 || '.*"' || chr(10) || string_agg(key || ' = ' || k || chr(10), '' order by k) as text from l group by n),
p as (select n, key, row_number() over (partition by n order by k) as rank, row_number() over (partition by n, key order by k) as nth from l),
v as (select n_regionkey as b, n_nationkey as c from nation order by b desc, c desc limit 1)
select 'duplicate_key' as kind, key, '' as detail, path, (instr(text, key) - 1 + strlen(key) + instr(substr(text, instr(text, key) + strlen(key)), key) - 1)::bigint as "offset", strlen(key)::bigint as length, rank::int as rank from p join t using (n) where nth > 1 and key <> 'replace_path'
union all select 'version_mismatch', '1.' || n % 5 || '.*', '1.' || b || '.' || c, path, (instr(text, '1.' || n % 5 || '.*') - 1)::bigint, strlen('1.' || n % 5 || '.*')::bigint, 0 from t cross join v where n % 5 <> b""",
        "drift_flag": _SCRIPTS + "select bool_or(before <> after) as drift, sum((before <> after)::int)::bigint as n_changed from t",
    }
