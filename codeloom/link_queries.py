"""Queries of routes, event logs, aliases, call chains, ranges of values and budgets, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import structured, text
from codeloom.operators import aliases, budget, chains, eventlog, facade, routes
from codeloom.plans.dsl import Engine
from codeloom.plans.graph import from_tables
from codeloom.queries import _t, query
from codeloom.sources.ranges import RangeIndex
from codeloom.sources.terms import TermIndex

# --- routes ---

_PATHS = r"""p as (select page_id, string_split(trim(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[?#].*$', ''), '/'), '/') as parts from pages where url is not null)"""


def _targets(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*(.*)$", 1).alias("target"), F.lit("get").alias("method")).where("target is not null")


@query(f"""with {_PATHS},
  r as (select distinct list_transform(parts, lambda x: case when regexp_matches(x, '[0-9]') then ':id' else x end) as pattern from p
        union select distinct list_transform(parts, lambda x: ':any') from p union select distinct parts from p where ends_with(parts[len(parts)], '.html')),
  k as (select pattern, '/' || array_to_string(pattern, '/') as route, len(list_filter(pattern, lambda x: not starts_with(x, ':'))) as literals from r),
  m as (select p.page_id as call_id, k.route as route_id, k.literals, row_number() over (partition by p.page_id order by k.literals desc) as best from p join k on len(p.parts) = len(k.pattern)
        and len(list_filter(range(1, len(p.parts) + 1), lambda i: case when starts_with(k.pattern[i], ':') then p.parts[i] = '' else p.parts[i] <> k.pattern[i] end)) = 0)
  select call_id, route_id, literals from m where best = 1""", graph=False)
def route_matches(spark, sf_dir):
    """Pages' URLs as calls; their templates, their shapes and the .html ones among them as routes."""
    calls = _targets(spark, sf_dir)
    parts = calls.select(routes.segments(F.col("target")).alias("parts"))
    template = parts.select(F.transform("parts", lambda x: F.when(x.rlike("[0-9]"), ":id").otherwise(x)).alias("pattern"))
    shape = parts.select(F.transform("parts", lambda x: F.lit(":any")).alias("pattern"))
    literal = parts.where(F.element_at("parts", -1).endswith(".html")).select(F.col("parts").alias("pattern"))
    known = template.union(shape).union(literal).distinct().select(F.concat(F.lit("/"), F.array_join("pattern", "/")).alias("path"))
    table = known.select(F.col("path").alias("route_id"), F.lit("GET").alias("method"), "path")
    return routes.matches(table, calls).select("call_id", "route_id", "literals")


# --- event log ---


def _order_events(spark, sf_dir) -> DataFrame:
    """Orders as changes of their customer's state: those with status P take back the customer's event before; each is caused by the one before."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = _t(spark, sf_dir, "orders").withColumn("before", before)
    undo = F.col("o_orderstatus") == "P"
    return o.select(F.col("o_orderkey").alias("event_id"), F.when(undo, "undo").otherwise("set").alias("kind"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"), F.when(undo, F.col("before")).alias("undoes"), F.col("before").alias("parent"))


@query("""with e as (select o_orderkey as id, o_custkey as c, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders),
  f as (select *, coalesce(min(case when s <> 'P' then rn end) over (partition by c order by rn rows between 1 following and unbounded following), n + 1) - rn - 1 as undone from e),
  g as (select c, max(id) as event_id from f where s <> 'P' and undone % 2 = 0 group by c)
  select 'customer:' || g.c as key, e.s as value, g.event_id from g join e on e.id = g.event_id""", graph=False)
def event_state(spark, sf_dir):
    return eventlog.state(_order_events(spark, sf_dir))


@query("""select o_orderkey as event_id, min(o_orderkey) over (partition by o_custkey) as root, row_number() over (partition by o_custkey order by o_orderkey) - 1 as steps from orders""", graph=False)
def event_causes(spark, sf_dir):
    return eventlog.causes(_order_events(spark, sf_dir))


# --- aliases ---

_URLS = r"u as (select page_id, regexp_replace(url, '[?#].*$', '') as name, regexp_extract(url, '^([A-Za-z]+://[^/?#]+/)', 1) as host, regexp_extract(url, '^([A-Za-z]+://[^/?#]+/[^/?#]+/)', 1) as folder from pages where url is not null)"


@query(f"""with {_URLS},
  a as (select distinct host as before, 'mirror/' || md5(host) as target from u where host <> '' union select distinct folder, 'folder/' || md5(folder) from u where folder <> ''),
  m as (select page_id as ref_id, target || '/' || substr(name, length(before) + 1) as target, before || '*' as pattern, row_number() over (partition by page_id order by length(before) desc) as best from u join a on starts_with(name, before))
  select ref_id, regexp_replace(target, '/$', '') as target, pattern from m where best = 1""", graph=False)
def alias_targets(spark, sf_dir):
    """Hosts and their first folders as nested aliases of all pages' URLs."""
    url = _t(spark, sf_dir, "pages").where("url is not null").select("page_id", "url")
    part = lambda more: F.regexp_extract("url", rf"^([A-Za-z]+://[^/?#]+/{more})", 1)
    rules = url.select(part("").alias("before"), F.lit("mirror/").alias("to")).union(url.select(part("[^/?#]+/"), F.lit("folder/"))).where("before <> ''").distinct()
    table = rules.select(F.lit("").alias("root"), F.concat("before", F.lit("*")).alias("pattern"), F.concat("to", F.md5("before"), F.lit("/*")).alias("target"), F.lit(0).alias("place"))
    refs = url.select(F.col("page_id").alias("ref_id"), F.lit("index").alias("path"), F.regexp_replace("url", r"[?#].*$", "").alias("name"))
    return aliases.rewrite(refs, table).select("ref_id", F.regexp_replace("target", "/$", "").alias("target"), "pattern")


# --- chains of calls ---


@query("""with l as (select o_custkey as c, max(o_orderkey) as o from orders group by o_custkey), f as (select l_orderkey as o, min(l_partkey) as p from lineitem group by l_orderkey)
  select c_custkey as ref_id, case when f.p is not null then p_brand || '.label' end as id, case when l.o is null then 0 when f.o is null then 1 else 3 end as found,
    case when l.o is null then 'customer:' || c_custkey when f.o is null then 'order:' || l.o else 'text' end as type
  from customer left join l on l.c = c_custkey left join f on f.o = l.o left join part on p_partkey = f.p""", graph=False)
def call_chains(spark, sf_dir):
    """customer.last().first().label(): a customer's last order, its first part, and the label that the part has of its brand."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    last = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o"))
    first = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    part = _t(spark, sf_dir, "part")
    members = last.select(name("customer", "o_custkey").alias("type"), F.lit("last").alias("member"), name("order", "o").alias("returns"), name("order", "o").alias("id"))
    members = members.union(first.select(name("order", "l_orderkey"), F.lit("first"), name("part", "p"), name("part", "p")))
    members = members.union(part.select("p_brand").distinct().select("p_brand", F.lit("label"), F.lit("text"), F.concat("p_brand", F.lit(".label"))))
    supers = part.select(name("part", "p_partkey").alias("type"), F.col("p_brand").alias("super"), F.lit(0).alias("place"))
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), name("customer", "c_custkey").alias("receiver"), F.array(*map(F.lit, ("last", "first", "label"))).alias("links"))
    return chains.resolve_chains(asked, members, supers)


# --- ranges of values, budgets ---


@query("select id, cast(score as double) as value from nodes where score between 1000 and 25000")
def score_range(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return RangeIndex.build(g.nodes.select("id", "score", "revision")).between("score", 1000, 25000)


@query("select id from nodes where kind = 'Function' and score between 1000 and 25000 and revision >= 23960")
def dsl_between(spark, sf_dir):
    return Engine(from_tables(spark, sf_dir)).query('fn("") | between score 1000 25000 | since 23960').select("id")


@query("""with b as (select source as file, doc_id as block, case lang when 'en' then 0 else 1 end as tier, coalesce(text, '') as text, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) as tokens, length(coalesce(text, '')) % 97 as score from documents),
  f as (select file, min(tier) as t, max(score) as s, sum(tokens) + 12 as total from b group by file),
  g as (select file, sum(total) over (order by t, s desc, file) - total as start from f),
  c as (select b.*, g.start, 150000 - g.start - 12 - (sum(tokens) over (partition by b.file order by tier, block) - tokens) as room from b join g on g.file = b.file where g.start + 12 < 150000),
  h as (select *, substr(text, 1, cast(room * 4 as bigint)) as head from c where room > 0 or tokens = 0 and room >= 0),
  k as (select file, block, tier, tokens <= room as whole, case when tokens <= room then text when contains(head, chr(10)) then regexp_extract(head, '^((?:.|\\n)*\\n)', 1) else head end as text from h)
  select file, block, tier, cast(ceil(length(text) / 4.0) as bigint) as tokens, whole, md5(text) as digest from k""", graph=False)
def budget_blocks(spark, sf_dir):
    """Documents as blocks of their sources, those in English first, for 150,000 tokens."""
    d = _t(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    blocks = d.select(F.col("source").alias("file"), F.col("doc_id").alias("block"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("tier"), (F.length(text) % 97).alias("score"), "text")
    return budget.select_blocks(blocks, 150_000, 12).select("file", "block", "tier", "tokens", "whole", F.md5("text").alias("digest"))


# --- words of names ---


@query("""with w as (select id, file_path, list_transform(string_split(name, ' '), lambda x: regexp_replace(x, 's$', '')) as words from nodes where kind = 'Struct'),
  h as (select *, len(list_filter(['small', 'r' || 'ing', 'widget'], lambda q: list_contains(words, q))) as hits from w),
  f as (select file_path, len(list_filter(['small', 'r' || 'ing', 'widget'], lambda q: list_contains(flatten(list(words)), q))) as together from h group by file_path)
  select h.id, cast(hits as int) as hits, cast(case when array_to_string(words, ' ') like '%small widget%' then 1 else 0 end as int) as phrases, cast(together as int) as together
  from h join f on f.file_path = h.file_path where hits > 0""")
def stem_matches(spark, sf_dir):
    """Rings, and small widgets as a compound, among all names; each is found by its stem."""
    g = from_tables(spark, sf_dir)
    nodes = g.nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # names are spelled out in as many tasks, however few the files
    return TermIndex.build(nodes).matches("rings Small_Widgets")


# --- small ones ---


@query("""select distinct n.file_path, n.id, n.name, n.kind from nodes n join edges e on e.dst = n.id and e.kind <> 'Contains' join nodes m on m.id = e.src where m.file_path <> n.file_path""")
def exported_symbols(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.exported_symbols(g.nodes, g.edges, g.nodes.select("file_path"))


@query("""with f as (select distinct l_suppkey as s, l_partkey as f from lineitem), n as (select s, count(*) as fields from f group by s)
  select l_orderkey as id, l_suppkey as struct, count(distinct l_partkey) as used, any_value(n.fields) as fields, count(distinct l_partkey) / any_value(n.fields) as share from lineitem join n on n.s = l_suppkey group by 1, 2""", graph=False)
def partial_structs(spark, sf_dir):
    """Suppliers as structs whose fields are the parts they supply, orders as functions that use some of them."""
    li = _t(spark, sf_dir, "lineitem")
    field = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))
    fields = li.select(F.col("l_suppkey").cast("string").alias("src"), field.alias("dst"), F.lit("Contains").alias("kind")).distinct()
    uses = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), field.alias("dst"), F.lit("References").alias("kind"))
    nodes = fields.select(F.col("dst").alias("id"), F.lit("Field").alias("kind")).union(uses.select("src", F.lit("Function")).distinct())
    found = facade.partial_structs(nodes, fields.unionByName(uses))
    return found.select(F.expr("cast(substring(id, 2) as bigint)").alias("id"), F.col("struct").cast("long").alias("struct"), "used", "fields", "share")


@query("select lang as language, count(*) as files, sum(n_chars) as nodes, max(doc_id) as last_indexed from documents group by lang", graph=False)
def languages_indexed(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return facade.languages_of(d.select(F.col("doc_id").alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("node_count"), F.col("doc_id").alias("indexed_at")))


@query("""with e as (select event_id, unnest(json_keys(props)) as key, props from events) select event_id, key, json_extract_string(props, '$.' || key) as value from e""", graph=False)
def json_members(spark, sf_dir):
    return structured.json_each(_t(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


@query(r"""select page_id from (select page_id, regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1) as path from pages) where regexp_full_match(path, '[^/]*/(?:en|fr)/[^/]*') or regexp_full_match(path, '(?:.*/)?[^/][^/][^/]\.html')""", graph=False)
def glob_paths(spark, sf_dir):
    path = F.regexp_extract("url", r"^[A-Za-z]+://([^?#]*)", 1)
    return _t(spark, sf_dir, "pages").where(text.matches_glob(path, "*/{en,fr}/*", "**/???.html")).select("page_id")
