"""Name ordering over ``part`` names and page urls."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.operators import ordering as op

A = f"a as ({fx.ASSETS_SQL})"


def _names(spark, sf):
    return fx.assets(spark, sf).select((F.col("asset_id") % 20).cast("string").alias("folder"), F.col("asset_id").cast("string").alias("path"), "name", "asset_id", "size")


@query("parse_names", f"with {A} select asset_id, size::double as scene, (asset_id % 13)::double as shot, (asset_id % 13)::double as trailing, case when name like '%cold%' then -1 else 0 end as position from a")
def parse_names(spark, sf):
    p = op.parse_names(_names(spark, sf))
    return p.select("asset_id", F.col("markers")[4].alias("scene"), F.col("markers")[6].alias("shot"), "trailing", "position")


@query("order_names", f"""with {A} select asset_id::varchar as path, row_number() over (partition by asset_id % 20 order by size, asset_id % 13, name, asset_id::varchar) - 1 as "order", 'scene ' || size || ' shot ' || (asset_id % 13) as reason from a""")
def order_names(spark, sf):
    files, _ = op.order_names(_names(spark, sf))
    return files.select("path", "order", "reason")


@query("order_warnings", f"""with {A} select (asset_id % 20)::varchar as folder, count(*) || ' clips share the position ' || size || '.' || (asset_id % 13) as warning from a group by asset_id % 20, size, asset_id % 13 having count(*) > 1""")
def order_warnings(spark, sf):
    return op.order_names(_names(spark, sf))[1]


@query("choose_scheme")
def choose_scheme(spark, sf):
    last = F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1)
    p = fx.table(spark, sf, "pages").select((F.col("page_id") % 7).cast("string").alias("folder"), F.col("url").alias("path"), last.alias("name"))
    return op.choose_scheme(op.parse_names(p)).select("folder", "scheme", "missing", F.size("levels").alias("levels"))


@query("natural_key", f"""with {A} select asset_id, row_number() over (order by size, asset_id % 13, lower(name), asset_id) as pos from a""")
def natural_key(spark, sf):
    from mediaframe.plans import scan

    n = _names(spark, sf).withColumn("k", op.natural_key(F.col("name"))).withColumn("one", F.lit(1))
    chunk = F.struct(F.get("k", 0).alias("a"), F.get("k", 1).alias("b"))
    return scan.ordered_scan(n, ["one"], [F.col("k"), F.col("asset_id")], chunk, pos=scan.number()).select("asset_id", "pos")


@query("sequence_gaps", f"""with d as (select distinct asset_id % 300 as g, size * 2 % 40 as v from ({fx.ASSETS_SQL})), n as (select g, v, lead(v) over (partition by g order by v) as nxt from d)
 select g, v + 1 as first, nxt - 1 as last, nxt - v - 1 as missing from n where nxt - v > 1""")
def sequence_gaps(spark, sf):
    d = fx.assets(spark, sf).select((F.col("asset_id") % 300).alias("g"), (F.col("size") * 2 % 40).alias("v"))
    return op.sequence_gaps(d, "g", "v")


@query("order_folder", f"""with {A}, v as (select asset_id % 20 as folder, asset_id, row_number() over (partition by asset_id % 20 order by asset_id) - 1 as o from a where kind = 'video'), n as (select folder, count(*) as n from v group by 1)
 select asset_id, o as "order" from v union all select asset_id, coalesce(n, 0) + row_number() over (partition by asset_id % 20 order by size, asset_id % 13, name, asset_id::varchar) - 1 from a left join n on n.folder = asset_id % 20 where kind <> 'video'""")
def order_folder(spark, sf):
    from mediaframe.plans import scan

    a = fx.assets(spark, sf).withColumn("folder", F.col("asset_id") % 20).withColumn("path", F.col("asset_id").cast("string"))
    v = scan.ordered_scan(a.filter(F.col("kind") == "video").select("folder", "path", "asset_id"), ["folder"], [F.col("asset_id")], F.floor(F.col("asset_id") / 5000), pos=scan.number()).withColumn("order", F.col("pos") - 1)
    return op.order_folder(v, a.filter(F.col("kind") != "video").select("folder", "path", "name", "kind")).select(F.col("path").cast("bigint").alias("asset_id"), "order")


STORY = f"s as (select asset_id // 250 as project_id, asset_id, row_number() over (partition by asset_id // 250 order by case when asset_id % 3 = 0 then asset_id % 50 else 1000000000 end, size, asset_id % 13, name, asset_id) - 1 as story_pos from a where kind = 'video')"


def _story(spark, sf):
    a = fx.assets(spark, sf).select(F.floor(F.col("asset_id") / 250).alias("project_id"), "asset_id", "kind", "name", F.when(F.col("asset_id") % 3 == 0, F.col("asset_id") % 50).alias("order"))
    return op.story_order(a).select("project_id", "asset_id", "story_pos")


@query("story_order", f"with {A}, {STORY} select project_id, asset_id, story_pos from s")
def story_order(spark, sf):
    return _story(spark, sf)


@query("reorder", f"""with {A}, {STORY}, m as (select project_id, story_pos as x, story_pos + 1 as y from s where asset_id = project_id * 250), t as (select project_id, max(story_pos) as top from s group by 1), k as (select m.* from m join t using (project_id) where y <= top)
 select s.project_id, asset_id, case story_pos when x then y when y then x else story_pos end as story_pos from s left join k using (project_id)""")
def reorder(spark, sf):
    s = _story(spark, sf)
    moves = s.select("project_id").distinct().select("project_id", (F.col("project_id") * 250).alias("asset_id"), F.lit(1).alias("dir"))
    return op.reorder(s, moves)


@query("library_view", f"with {A} select asset_id, kind from a")
def library_view(spark, sf):
    a = fx.assets(spark, sf).withColumn("tags", F.array("brand")).withColumn("order", F.col("asset_id"))
    return op.library_view(a, "duration").select("asset_id", "kind")


@query("dedupe_inputs", "select 'c:/' || (p_partkey % 700) as path_key, min(p_partkey) as position from part group by 1")
def dedupe_inputs(spark, sf):
    return op.dedupe_inputs(fx.table(spark, sf, "part").select(F.concat(F.lit("c:/"), (F.col("p_partkey") % 700).cast("string")).alias("path_key"), F.col("p_partkey").alias("position")))


@query("prompt_set", "select p_name as prompt, min(p_partkey) as position from part group by 1")
def prompt_set(spark, sf):
    return op.prompt_set(fx.table(spark, sf, "part").select(F.col("p_name").alias("prompt"), F.col("p_partkey").alias("position")))


@query("roman_numerals", "select p_partkey as id, (p_partkey % 9 + 1)::double as value from part")
def roman_numerals(spark, sf):
    digits = F.array(*[F.lit(x) for x in ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")])
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), op.roman(F.get(digits, (F.col("p_partkey") % 9).cast("int"))).alias("value"))
