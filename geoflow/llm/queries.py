"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import table
from . import audit, decontaminate, encoding, language, lines, neardup, ordermin, packing, quotes, sharding, tokencount, toxicity, vectorcodes
from .common import crc_of_id, whole_text

SHARDS, CONTEXT, OVER, SITES = 24, 2048, 1024, 10


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = whole_text(docs)
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return sharding.shard(slim, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokencount.with_token_counts(docs, path or tokenizer_file("byte_bpe_50k.json"))
    return found.select("doc_id", F.octet_length(whole_text(found)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))


def op3_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_into_pieces(docs, path or tokenizer_file("word_bpe_49k.json"), CONTEXT)
    return packing.pack(pieces, CONTEXT, ["doc_id", "piece"])


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = ordermin.with_fingerprint(docs.select("doc_id", whole_text(docs).alias("text")), "text", "fp")
    docs = ordermin.with_edit(ordermin.with_next(docs, "doc_id", ["text", "fp"]), "text", "next_text")
    docs = ordermin.with_fingerprint(docs, "edited", "edited_fp")
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), ordermin.shown("fp").alias("fingerprint"),
        ordermin.shown("edited_fp").alias("edited_fingerprint"), ordermin.likeness("fp", "edited_fp").alias("near_edited"), ordermin.likeness("fp", "next_fp").alias("near_next"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = lines.without_boilerplate(docs, SITES, counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.reply_ordered(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "body", "n_quoted", "reply_to", "thread_root", "position")


def quoting_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as if each message quoted the three before it, nested: the given ones hold no quotes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    found = rows
    for k in (1, 2, 3):
        marks = "> " * k
        before = rows.select("conv_id", (F.col("turn") + k).alias("turn"), F.concat(F.lit(marks), F.replace("text", F.lit("\n"), F.lit(f"\n{marks}"))).alias(f"q{k}"))
        found = found.join(before, ["conv_id", "turn"], "left")
    return found.select("conv_id", "turn", "role", F.concat_ws("\n", "q3", "q2", "q1", "text").alias("text"))


def nested_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking on ``quoting_conversations``."""
    found = quotes.reply_ordered(quoting_conversations(spark, sf_dir))
    return found.select("conv_id", "turn", "role", "body", "n_quoted", "reply_to", "thread_root", "position")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.n_hit())
    items = F.sha2(F.array_join("hits.items", ","), 256)
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), "n_hit", F.size("hits.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.with_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = language.train(docs, ~held_out)
    return language.with_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vectorcodes.train(vectors)
    coded = vectorcodes.with_codes(vectors, books).select("vec_id", "label", "code", "error")
    found = vectorcodes.with_label_errors(coded)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.books_sha256(books)).alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_bpe_reuse(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encoding.with_encoding(docs, path or tokenizer_file("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_sharding": op1_sharding, "op2_token_counts": op2_token_counts, "op3_packing": op3_packing, "op4_order_minhash": op4_order_minhash,
        "op5_near_duplicates": op5_near_duplicates, "op6_line_dedup": op6_line_dedup, "op7_quotation_linking": op7_quotation_linking,
        "op8_decontamination": op8_decontamination, "op9_toxicity": op9_toxicity, "op10_language": op10_language, "pipeline": corpus_pipeline.run,
        "op11_vector_codes": op11_vector_codes, "op12_filter_audit": op12_filter_audit, "op13_bpe_reuse": op13_bpe_reuse,
        "nested_quotes": nested_quotes,
    }


SQL = {
    "op6_line_dedup": f"""
with l as (select source, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
spread as (select line from l where trim(line) <> '' group by line having count(distinct coalesce(source, '')) >= {SITES}),
docs as (select row_number() over (order by doc_id, text) as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
placed as (select r, generate_subscripts(parts, 1) as place, unnest(parts) as line from docs),
kept as (select r, count(*) as n, string_agg(line, chr(10) order by place) as text from placed where line not in (select line from spread) group by r)
select doc_id, cast(len(parts) as bigint) as n_lines, cast(len(parts) - coalesce(n, 0) as bigint) as n_removed, md5(coalesce(kept.text, '')) as text_md5
from docs left join kept using (r)""",
    "op7_quotation_linking": r"""
with recursive m as (select row_number() over (order by conv_id, turn, role, text) as r, conv_id, cast(turn as bigint) as turn, role, string_split(coalesce(text, ''), chr(10)) as parts from conversations),
l as (select r, conv_id, turn, generate_subscripts(parts, 1) as place, unnest(parts) as line from m),
v as (select *, length(replace(regexp_extract(line, '^(> ?)+'), ' ', '')) as level, regexp_replace(line, '^(> ?)+', '') as rest from l),
n as (select *, case when level is distinct from lag(level) over (partition by r order by place) then 1 else 0 end as fresh from v),
u as (select *, sum(fresh) over (partition by r order by place) as run from n),
p as (select r, conv_id, turn, level, string_agg(rest, chr(10) order by place) as passage from u group by r, conv_id, turn, level, run
      union all select r, conv_id, turn, level, rest from u),
q as (select distinct r, conv_id, turn, level, trim(regexp_replace(lower(passage), '\s+', ' ', 'g')) as passage from p),
own as (select conv_id, passage, arg_min(r, turn) as parent, min(turn) as parent_turn from q where level = 0 and passage <> '' group by conv_id, passage),
quoted as (select q.r, level, length(q.passage) as n, parent, parent_turn from q join own using (conv_id, passage) where level > 0 and parent_turn < q.turn),
link as (select r, parent, parent_turn as reply_to from quoted qualify row_number() over (partition by r order by level, n desc, parent_turn desc) = 1),
up as (select r, r as root from m where r not in (select r from link) union all select link.r, up.root from link join up on link.parent = up.r),
f as (select m.*, reply_to, root, t.turn as thread_root from m left join link using (r) join up using (r) join (select r as root, turn from m) t using (root))
select conv_id, turn, role, trim(array_to_string(list_filter(parts, lambda x: not starts_with(x, '>')), chr(10))) as body,
  cast(len(list_filter(parts, lambda x: starts_with(x, '>'))) as bigint) as n_quoted, reply_to, thread_root,
  row_number() over (partition by conv_id order by thread_root, root, turn, r) - 1 as position from f""",
}


def codes_sql() -> str:
    """Product codes with the rounds of refinement written out one after another."""
    dim, far = "(select len(v) // 4 from q limit 1)", "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))"
    near = lambda k: f"select a.r, a.p, min((cast({far} as bigint), c.e)) as best from a join c{k} c using (p) group by a.r, a.p"
    steps = []
    for k in range(vectorcodes.ROUNDS):
        steps.append(f"""n{k} as materialized ({near(k)}),
m{k} as materialized (select p, e, list(m order by i) as v from (
  select p, e, i, (s - ((s % n) + n) % n) // n as m from (select p, best[2] as e, i, sum(a.v[i]) as s, count(*) as n from n{k} join a using (r, p), range(1, {dim} + 1) t(i) group by all)) group by p, e),
c{k + 1} as materialized (select c.p, c.e, coalesce(m.v, c.v) as v from c{k} c left join m{k} m using (p, e))""")
    last = vectorcodes.ROUNDS
    return f"""
with q as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as materialized (select r, p, v[p * {dim} + 1 : (p + 1) * {dim}] as v from q, range(4) t(p)),
c0 as materialized (select p, r as e, v from a where r < 256),
{", ".join(steps)},
f as materialized ({near(last)}),
rows as (select r, string_agg(lower(lpad(to_hex(best[2]), 2, '0')), '' order by p) as code, cast(sum(best[1]) as bigint) as error from f group by r),
sums as (select label, sum(error) as label_error from rows join q using (r) group by label),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from c{last})
select vec_id, code, error, cast(label_error as bigint) as label_error, codebooks_sha256 from rows join q using (r) join sums on sums.label is not distinct from q.label, books"""


SQL["op11_vector_codes"] = codes_sql()
SQL["op12_filter_audit"] = r"""
with recursive d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
least as (select t, min(doc_id) as least from d group by t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as q, max(case when toxic = 1 then 1 else 0 end) as x from labels group by doc_id),
w as (select d.*, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') as words from d),
f as (select part, coalesce(q, 0) as q, coalesce(x, 0) as x, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), least is not null and (doc_id is null or doc_id > least)] as fails from w join least using (t) left join marks using (doc_id)),
o as (select '' as done union all select done || l from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(l) where position(l in done) = 0),
s as (select done as filter_order, cast(k as integer) as step, ascii(done[k]) - 64 as own, list_transform(range(1, k), lambda i: ascii(done[i]) - 64) as before from o, range(1, 6) r(k) where length(done) = 5),
g as (select part, fails, count(*) as n, sum(q) as q, sum(x) as x from f group by all),
c as (select part, filter_order, step, own, n, q, x, fails[own] as fail, len(list_filter(before, lambda b: fails[b])) > 0 as early, len(list_filter(fails, lambda y: y)) = 1 as alone from g, s),
e as (select part, filter_order, step, own, sum(case when not fail and not early then n else 0 end) as kept, sum(case when fail and not early then n else 0 end) as removed,
  sum(case when fail and early then n else 0 end) as redundant, sum(case when fail and alone then n else 0 end) as unique_fails, sum(case when fail and not early then q else 0 end) as good_lost, sum(case when fail and not early then x else 0 end) as toxic_lost from c group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from e"""
QUOTING = ", ".join(f"'{'> ' * k}' || replace(q{k}.text, chr(10), chr(10) || '{'> ' * k}')" for k in (3, 2, 1))
QUOTED = " ".join(f"left join given q{k} on q{k}.conv_id = g.conv_id and q{k}.turn + {k} = g.turn" for k in (1, 2, 3))
VIEW = f"""given as (select conv_id, cast(turn as bigint) as turn, role, text from conversations),
quoting as (select g.conv_id, g.turn, g.role, concat_ws(chr(10), {QUOTING}, g.text) as text from given g {QUOTED})"""
SQL["nested_quotes"] = SQL["op7_quotation_linking"].replace("from conversations)", "from quoting)").replace("with recursive m as", f"with recursive {VIEW}, m as")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
