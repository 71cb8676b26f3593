"""One query per operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, decontaminate, filter_audit, hosts, jaccard_join, language, line_dedup, materialise, packing, pii, quality_rules,
    toxicity, vector_codes,
)
from .common import held_out, read
from .hosts import SECOND_LEVEL


ORDER_KEY = 20_240_607  # a training run's own; any number

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(read(spark, sf_dir, "documents"))
    found = decontaminate.find(spark, index, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in pii.KINDS],
                        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sample = quality_rules.train_sample(docs, read(spark, sf_dir, "labels"))
    rules = quality_rules.learn(quality_rules.with_counts(sample))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def tokenizer_path() -> str:
    """The public vocabulary that the contracts name; operators take any such path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = materialise.materialise(read(spark, sf_dir, "documents"), tokenizer_path(), key=ORDER_KEY)
    return rows


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = read(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, known))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out("doc_id")))
    return language.predict(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "shares")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return hosts.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_groups(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = filter_audit.with_labels(
        filter_audit.failing(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"),
        {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    names = list(filter_audit.FILTERS)
    return filter_audit.audit(filter_audit.posting_lists(marked, [*names, "good", "toxic"]), names, ["good", "toxic"])


TRICKY = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.union(tricky)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_training_order": op4_training_order,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_url_reputation": op9_url_reputation,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_format": op12_chat_format,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql() -> str:
    """Six rounds of assignment and update, one after the other."""
    gap = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(books: str) -> str:
        return f"""select vec_id, x.p, any_value(v) as v, min({{'d': {gap}, 'e': e}}) as best
            from parts x join {books} b on b.p = x.p group by vec_id, x.p"""

    steps = ["""
        kept as materialized (
            select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as q from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        parts as materialized (
            select vec_id, p, q[p * len(q) // 8 + 1:(p + 1) * len(q) // 8] as v from kept, range(8) t(p)),
        books0 as materialized (
            select p, v as c, row_number() over (partition by p order by vec_id) - 1 as e from parts
            qualify row_number() over (partition by p order by vec_id) <= 16)"""]
    for i in range(vector_codes.ROUNDS):
        steps.append(f"""
        near{i} as materialized ({assigned(f'books{i}')}),
        sums{i} as (
            select p, best.e as e, k, sum(v[k + 1])::bigint as s, count(*) as n from near{i}, (select unnest(range(max(len(v)))) as k from parts)
            group by p, best.e, k),
        means{i} as (select p, e, list((s - ((s % n) + n) % n) // n order by k) as c from sums{i} group by p, e),
        books{i + 1} as materialized (select p, e, coalesce(m.c, b.c) as c from books{i} b left join means{i} m using (p, e))""")
    last = f"books{vector_codes.ROUNDS}"
    return "with " + ",".join(steps) + f""",
        final as materialized ({assigned(last)}),
        coded as (
            select vec_id, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error
            from final group by vec_id),
        digest as (
            select sha256(string_agg(x::varchar, ',' order by p, e, k)) as h
            from (select p, e, unnest(c) as x, generate_subscripts(c, 1) as k from {last}))
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256
        from coded join kept using (vec_id), digest"""


ORACLE = {
    "op1_decontaminate": r"""
        with lowered as (
            select 'd' as kind, doc_id as id, coalesce(text, '') as text from documents
            union all select 'b', item_id, coalesce(text, '') from benchmark),
        listed as (
            select kind, id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
        phrases as (
            select id as item_id, least(13, len(w)) as n,
                   unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
                                         lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) as phrase
            from listed where kind = 'b' and len(w) > 0),
        sizes as (select distinct n from phrases),
        places as (
            select id as doc_id, n, w, unnest(range(1, len(w) - n + 2)) as spot from listed, sizes
            where kind = 'd' and len(w) >= n),
        hits as (
            select distinct doc_id, p.n, spot, item_id from places join phrases p
            on p.n = places.n and p.phrase = array_to_string(w[spot:spot + places.n - 1], ' ')),
        covered as (select doc_id, count(distinct spot + k) as n_hit
                    from (select doc_id, spot, unnest(range(0, n)) as k from hits) group by doc_id),
        named as (select doc_id, count(distinct item_id) as n_items,
                         string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
                  from hits group by doc_id)
        select l.id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
               coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from listed l left join covered c on c.doc_id = l.id left join named m on m.doc_id = l.id
        where kind = 'd'""",
    "op7_line_dedup": r"""
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        keyed as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
        often as (
            select k, max(doc_id) as keeper from keyed where length(k) >= 40
            group by k having count(distinct doc_id) >= 5),
        judged as (
            select d.*, coalesce(o.keeper <> d.doc_id, false) as dropped
            from keyed d left join often o on o.k = d.k)
        select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
        from judged group by doc_id""",
    "op9_url_reputation": rf"""
        with parts as (
            select page_id, url,
                   case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end as raw_host,
                   case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
            from pages),
        cut as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
        rules(what, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                              ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fitting as (
            select page_id, max_by(h || p, length(h || p)) as rule, max_by(what, length(h || p)) as what
            from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
        beside as (
            select distinct page_id from cut join rules on (host = h or ends_with(host, '.' || h)) and not starts_with(path, p)
            where rules.what = 'block' and p not in ('', '/')),
        judged as (
            select c.*, f.rule, f.what, case when f.what is not null then (f.what = 'block')::int when b.page_id is not null then 0 end as bad
            from cut c left join fitting f using (page_id) left join beside b using (page_id)),
        tails as (
            select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad, string_split(host, '.') as l,
                   array_to_string(string_split(host, '.')[-2:], '.') as two,
                   len(string_split(host, '.')) >= 2 and array_to_string(string_split(host, '.')[-2:], '.') in {SECOND_LEVEL} as deep
            from judged group by host),
        per_host as (
            select host, n, bad,
                   case when deep and len(l) >= 3 then array_to_string(l[-3:], '.') when len(l) >= 2 then two else host end as domain,
                   case when deep then two else l[-1] end as suffix
            from tails),
        per_domain as (select domain, suffix, sum(n) as n, sum(bad) as bad from per_host group by all),
        per_suffix as (select suffix, sum(n) as n, sum(bad) as bad from per_domain group by all),
        total as (select case when sum(n) > 0 then (sum(bad) + 1) / (sum(n) + 2) else 0.5 end as c from per_suffix),
        moments as (
            select 'host' as level, count(*) as k, sum(n) as n, sum(n * n) as nn, sum(bad * bad / n) as s from per_host where n > 0
            union all select 'domain', count(*), sum(n), sum(n * n), sum(bad * bad / n) from per_domain where n > 0
            union all select 'suffix', count(*), sum(n), sum(n * n), sum(bad * bad / n) from per_suffix where n > 0),
        strength as (
            select level, 1 / least(0.5, greatest(0.01,
                case when k > 1 and c > 0 and c < 1 and c * (1 - c) * (n - nn / n - (k - 1)) > 0
                     then (s - n * c * c - c * (1 - c) * (k - 1)) / (c * (1 - c) * (n - nn / n - (k - 1)))
                     else 0.5 end)) - 1 as m
            from moments, total),
        s as (select suffix, (m * c + bad) / (m + n) as mean from per_suffix, total, strength where level = 'suffix'),
        d as (select domain, suffix, (m * mean + bad) / (m + n) as mean from per_domain join s using (suffix), strength where level = 'domain'),
        h as (select host, m * mean + bad as a, m * (1 - mean) + n - bad as b
              from per_host join d using (domain, suffix), strength where level = 'host'),
        bounds as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from h)
        select page_id, host, path, rule, coalesce(what, case when low > 0.5 then 'block' else 'allow' end) as verdict
        from judged join bounds using (host)""",
    "op11_filter_audit": r"""
        with docs as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        known as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
                  from labels group by doc_id),
        masks as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                   (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
                   + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::int
                   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by t))::int as m
            from docs left join known using (doc_id)),
        counts as (select part, good, toxic, m, count(*) as n from masks group by all),
        letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders as (
            select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
            from letters a, letters b, letters c, letters d, letters e where a.b + b.b + c.b + d.b + e.b = 31
            and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
        steps as (
            select filter_order, s as step, bits[s] as f, coalesce(list_sum(bits[1:s - 1]), 0)::int as done
            from orders, range(1, 6) t(s)),
        sized as (
            select part, filter_order, step, f, sum(n) filter ((m & (done | f)) = 0) as kept,
                   sum(n) filter ((m & f) > 0 and (m & done) = 0) as removed, sum(n) filter ((m & f) > 0 and (m & done) > 0) as redundant,
                   sum(n) filter (m = f) as unique_fails,
                   sum(n) filter (good and (m & f) > 0 and (m & done) = 0) as good_lost,
                   sum(n) filter (toxic and (m & f) > 0 and (m & done) = 0) as toxic_lost
            from counts, steps group by all)
        select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
               coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
               coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
               (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley
        from sized""",
    "op12_chat_format": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        sized as (
            select *, length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '### ', ''))) // 4
                     + (length(role) - length(replace(role, '</turn>', ''))) // 7 + length(role) - length(replace(role, chr(10), ''))
                     + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '### ', ''))) // 4
                     + (length(text) - length(replace(text, '</turn>', ''))) // 7 as escapes
            from turns)
        select conv_id, count(*)::bigint as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(13 + length(role) + length(text) + escapes)::bigint as formatted_chars
        from sized group by conv_id""",
    "op13_vector_codes": _codes_sql(),
}
