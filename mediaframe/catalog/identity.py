"""Identity queries over ``embeddings``: every fifth vector is a reference owned by its label."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.operators import identity as op

SIMS = f"""with b as ({fx.BANK_SQL}), q as ({fx.QUERIES_SQL}),
 s as (select q.vec_id, q.truth, b.owner, b.vec_id as crop_group, list_cosine_similarity(q.emb, b.emb) as sim from q cross join b),
 k as (select *, row_number() over (partition by vec_id, owner order by sim desc, crop_group) as rank from s),
 sc as (select vec_id, owner, avg(sim) as score from k where rank <= 3 group by 1, 2),
 o as (select *, row_number() over (partition by vec_id order by score desc, owner) as rn from sc),
 idd as (select vec_id, max(case when rn = 1 then owner end) as best, max(case when rn = 1 then score end) as score,
   max(case when rn = 1 then score end) - coalesce(max(case when rn = 2 then score end), 0) as margin from o group by 1),
 e as (select vec_id, owner, exp(100 * sim - max(100 * sim) over (partition by vec_id)) as e from s),
 z as (select vec_id, owner, sum(e) / sum(sum(e)) over (partition by vec_id) as prob from e group by 1, 2)
"""


@query("top_k_similar", SIMS + "select vec_id, owner, crop_group, rank, round(sim, 7) + 0.0 as sim from k where rank <= 3")
def top_k_similar(spark, sf):
    out = op.top_k_similar(fx.probes(spark, sf), fx.bank(spark, sf))
    return out.select("vec_id", "owner", "crop_group", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 7).alias("sim"))


@query("identify", SIMS + """select vec_id, best, round(score, 7) + 0.0 as score, round(margin, 7) + 0.0 as margin,
  case when score >= 0.4 and margin >= 0.05 then best end as owner from idd""")
def identify(spark, sf):
    out = op.identify(op.owner_scores(fx.probes(spark, sf), fx.bank(spark, sf)), 0.4, 0.05)
    return out.select("vec_id", "best", F.round("score", 7).alias("score"), F.round("margin", 7).alias("margin"), "owner")


HEADS = f"""with b as ({fx.BANK_SQL}), q as ({fx.QUERIES_SQL}),
 p as (select vec_id, false as head, emb from q union all select vec_id, true, list_concat(emb[9:], emb[:8]) from q where vec_id % 3 = 0),
 r as (select false as head, owner, vec_id, emb from b union all select true, owner, vec_id, list_concat(emb[5:], emb[:4]) from b where vec_id % 10 = 0),
 s as (select p.vec_id, p.head, r.owner, r.vec_id as crop_group, list_cosine_similarity(p.emb, r.emb) as sim from p join r on p.head = r.head),
 k as (select *, row_number() over (partition by vec_id, head, owner order by sim desc, crop_group) as rank from s),
 h as (select vec_id, head, owner, avg(sim) as score from k where rank <= 3 group by 1, 2, 3), sc as (select vec_id, owner, max(score) as score from h group by 1, 2),
 o as (select *, row_number() over (partition by vec_id order by score desc, owner) as rn from sc),
 idd as (select vec_id, max(case when rn = 1 then owner end) as best, max(case when rn = 1 then score end) as score,
   max(case when rn = 1 then score end) - coalesce(max(case when rn = 2 then score end), 0) as margin from o group by 1)
"""


@query("identify_heads", HEADS + """select vec_id, best, round(score, 7) + 0.0 as score, round(margin, 7) + 0.0 as margin,
  case when score >= 0.4 and margin >= 0.05 then best end as owner from idd""")
def identify_heads(spark, sf):
    turned = lambda n: F.concat(F.slice("embedding", n + 1, 100_000), F.slice("embedding", 1, n))
    probes = fx.probes(spark, sf).withColumn("head", F.when(F.col("vec_id") % 3 == 0, turned(8)))
    bank = fx.bank(spark, sf).withColumn("head", F.lit(False))
    heads = bank.filter(F.col("ref_id") % 10 == 0).withColumns({"embedding": turned(4), "head": F.lit(True)})
    out = op.identify(op.owner_scores_with_heads(probes, bank.unionByName(heads)), 0.4, 0.05)
    return out.select("vec_id", "best", F.round("score", 7).alias("score"), F.round("margin", 7).alias("margin"), "owner")


@query("zero_shot", SIMS + "select vec_id, owner, round(prob, 7) + 0.0 as prob from z")
def zero_shot(spark, sf):
    out = op.zero_shot(fx.probes(spark, sf), fx.bank(spark, sf))
    return out.select("vec_id", "owner", F.round("prob", 7).alias("prob"))


@query("open_set_reject", SIMS + """, n as (select vec_id, avg(sim) as ns from (select vec_id, sim, row_number() over (partition by vec_id order by sim desc, crop_group) as r from s where owner = 9) where r <= 3 group by 1),
  i as (select vec_id, max(case when rn = 1 then owner end) as best, max(case when rn = 1 then score end) as score
    from (select *, row_number() over (partition by vec_id order by score desc, owner) as rn from sc where owner <> 9) group by 1)
  select i.vec_id, i.best, case when i.score < 0.1 then null when zn.prob >= 0.5 and zn.prob > coalesce(zo.prob, 0) then 'text'
    when coalesce(ns, 0) > 0 and ns >= i.score then 'reference' end as rejected
  from i left join z zn on zn.vec_id = i.vec_id and zn.owner = 9 left join z zo on zo.vec_id = i.vec_id and zo.owner = i.best left join n on n.vec_id = i.vec_id""")
def open_set_reject(spark, sf):
    bank, probes = fx.bank(spark, sf), fx.probes(spark, sf)
    own, neg = bank.filter("owner <> 9"), bank.filter("owner = 9")
    texts = bank.withColumn("owner", F.when(F.col("owner") == 9, op.NEGATIVE_OWNER).otherwise(F.col("owner")))
    identified = op.identify(op.owner_scores(probes, own), 0.4, 0.05)
    negative = op.owner_scores(probes, neg).select("vec_id", F.col("score").alias("neg_score"))
    return op.open_set_reject(identified, op.zero_shot(probes, texts), negative, floor=0.1).select("vec_id", "best", "rejected")


CALIB = """with r as (select vec_id, label as owner, vec_id // 7 as image, vec_id % 2 = 0 as lineup, embedding::double[] as emb from embeddings),
 s as (select q.vec_id, q.owner as truth, b.owner, list_cosine_similarity(q.emb, b.emb) as sim, b.vec_id as crop_group from r q join r b on q.lineup <> b.lineup and q.image <> b.image),
 k as (select *, row_number() over (partition by vec_id, owner order by sim desc, crop_group) as rank from s),
 sc as (select vec_id, truth, owner, avg(sim) as score from k where rank <= 3 group by 1, 2, 3),
 c as (select vec_id, truth, max(case when owner = truth then score end) as pos, coalesce(max(case when owner <> truth then score end), 0) as wrong from sc group by 1, 2 having pos is not null)
"""


def _calibration(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return op.calibration_rows(e.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("owner"), F.col("vec_id").alias("crop_group"),
                                        F.floor(F.col("vec_id") / 7).alias("image"), (F.col("vec_id") % 2 == 0).alias("lineup"), "embedding"))


@query("calibrate", CALIB + """select count(*) as queries, round(avg(case when pos > wrong then 1.0 else 0.0 end), 7) as top1_accuracy, round(quantile_cont(pos, 0.1), 7) as pos_p10,
  round(quantile_cont(pos, 0.5), 7) as pos_median, round(quantile_cont(wrong, 0.9), 7) as wrong_p90, round(quantile_cont(wrong, 0.5), 7) as wrong_median,
  round((quantile_cont(pos, 0.1) + quantile_cont(wrong, 0.9)) / 2, 7) as raw_threshold, round(least(greatest((quantile_cont(pos, 0.1) + quantile_cont(wrong, 0.9)) / 2, 0.68), 0.74), 7) as threshold,
  round(least(greatest(coalesce(quantile_cont(pos - wrong, 0.1) filter (pos > wrong) / 2, 0.06), 0.05), 0.08), 7) as margin from c""")
def calibrate(spark, sf):
    out = op.calibrate(_calibration(spark, sf))
    return out.select(F.col("queries").cast("bigint").alias("queries"), *[F.round(c, 7).alias(c) for c in out.columns if c != "queries"])


@query("owner_accuracy", CALIB + "select truth as owner, count(*) as queries, round(avg(case when pos > wrong then 1.0 else 0.0 end), 7) as top1_accuracy from c group by 1")
def owner_accuracy(spark, sf):
    return op.owner_accuracy(_calibration(spark, sf)).select("owner", "queries", F.round("top1_accuracy", 7).alias("top1_accuracy"))


@query("crop_group", """select id, src, regexp_replace(src, '#.*$', '') || '#' || case when regexp_extract(tag, '^(\\d+r?)', 1) <> '' then regexp_extract(tag, '^(\\d+r?)', 1) else tag end as grp
  from (select vec_id as id, 'sheet' || label || '.webp#' || vec_id || (case vec_id % 3 when 0 then 'rh' when 1 then 'f' else '' end) as src,
   vec_id || (case vec_id % 3 when 0 then 'rh' when 1 then 'f' else '' end) as tag from embeddings)""")
def crop_group(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    tag = F.when(F.col("vec_id") % 3 == 0, "rh").when(F.col("vec_id") % 3 == 1, "f").otherwise("")
    src = F.concat(F.lit("sheet"), F.col("label").cast("string"), F.lit(".webp#"), F.col("vec_id").cast("string"), tag)
    return e.select(F.col("vec_id").alias("id"), src.alias("src"), op.crop_group(src).alias("grp"))


@query("dedupe_references", """with recursive r as (select vec_id, label, embedding::double[] as e, row_number() over (partition by label order by case when vec_id % 2 = 0 then 0 else 1 end, vec_id) as k from embeddings),
 g as (select label, k, [e] as kept, [vec_id] as ids from r where k = 1
  union all select r.label, r.k, case when list_max(list_transform(g.kept, lambda x: list_inner_product(x, r.e))) > 0.3 then g.kept else list_append(g.kept, r.e) end,
   case when list_max(list_transform(g.kept, lambda x: list_inner_product(x, r.e))) > 0.3 then g.ids else list_append(g.ids, r.vec_id) end from g join r on r.label = g.label and r.k = g.k + 1)
 select unnest(ids) as ref_id, label as owner from (select label, ids from g qualify row_number() over (partition by label order by k desc) = 1)""")
def dedupe_references(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    src = F.concat(F.lit("img.webp#"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 1, "r").otherwise(""))
    return op.dedupe_references(e.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("owner"), src.alias("source"), "embedding"), 0.3).select("ref_id", "owner")
