"""The driver's queries on the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import chat, cotraining, decontaminate, exact_dedup, filter_audit, lengths, line_dedup, mixing, near_dedup, packing, resampling, secrets, toxicity
from turnledger.llm.text import read_table
from turnledger.session import ship_package, stored


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.encoded_lengths(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_guess", F.round("most_cost", 3).alias("most_cost"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read_table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns(read_table(spark, sf_dir, "conversations"))
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = rows.unionByName(planted.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))
    return chat.read_back(chat.format_turns(rows, vocabulary("byte_bpe_50k.tiktoken")), vocabulary("byte_bpe_50k.tiktoken"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    views = cotraining.stored_views(docs)
    return cotraining.score(docs, cotraining.fit(docs, read_table(spark, sf_dir, "labels"), views=views), views=views)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_files(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(read_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_toxicity, op3_secrets, op4_exact_dedup, op5_packing, op6_near_dedup, op7_chat, op8_decontaminate, op9_quality, op10_line_dedup, op11_filter_audit, op12_resampling, op13_mixing)
    return {q.__name__: shipped(q) for q in every}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    text, key_chars = LOWER.format("coalesce(text, '')"), "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    escaped = "replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || '<')"
    counted, removed = (lambda n, rows: f"cast(coalesce(sum({n}) filter ({rows}), 0) as bigint)"), "mask & bit > 0 and mask & earlier = 0"
    return {
        "op4_exact_dedup": """
            with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents),
            g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
            select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t""",
        "op6_near_dedup": f"""
            with recursive w as (select doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
            s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
            n as (select w.doc_id, count(g) as n from w left join s using (doc_id) group by w.doc_id),
            links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
                where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
            reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
            c as (select n.doc_id, n.n, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id from n left join reach r on r.a = n.doc_id group by n.doc_id, n.n)
            select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from c""",
        "op7_chat": f"""
            with p as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' union all select -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
            select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
                cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
                sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
                cast(sum(length('{chat.TURN}{chat.SAYS}{chat.END}') + length({escaped.format("role")}) + length({escaped.format("text")})) as bigint) as formatted_chars
            from p group by conv_id""",
        "op8_decontaminate": f"""
            with d as (select doc_id, {words} as ws from documents),
            i as (select item_id, {words} as ws from benchmark),
            bw as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') as w from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from i where len(ws) > 0)),
            dw as (select doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') as w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, (select distinct n from bw) where len(ws) >= n)),
            m as (select dw.doc_id, dw.p, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.w = bw.w),
            h as (select doc_id, count(*) as n_hit from (select distinct doc_id, p + k as q from (select doc_id, p, unnest(range(0, n)) as k from m)) group by doc_id),
            it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
            select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(it.n_items, 0) as n_items, sha256(coalesce(it.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
            from d left join h using (doc_id) left join it using (doc_id)""",
        "op10_line_dedup": f"""
            with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
            l as (select doc_id, i, ls[i] as line, {LOWER.format(f"trim(ls[i], {key_chars})")} as k from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from s)),
            o as (select k, min(doc_id) as owner from l where length(k) >= 10 group by k having count(distinct doc_id) > 1),
            f as (select l.*, o.owner is not null and o.owner <> l.doc_id as lost from l left join o on l.k = o.k)
            select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256 from f group by doc_id""",
        "op11_filter_audit": f"""
            with l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
            t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
            w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as first_id from t),
            m as (select w.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                cast(len(ws) < 100 as int) + 2 * cast(100 * len(list_distinct(ws)) < 80 * len(ws) as int) + 4 * cast(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) as int)
                + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(w.doc_id > first_id as int) as mask from w left join l on w.doc_id = l.doc_id),
            c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
            f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
            o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
            s as (select filter_order, cast(step as int) as step, bits[step] as bit, coalesce(list_sum(bits[1 : step - 1]), 0)::int as earlier from (select *, unnest(range(1, 6)) as step from o))
            select part, filter_order, step, {counted("n", "mask & (bit | earlier) = 0")} as kept, {counted("n", removed)} as removed, {counted("n", "mask & bit > 0 and mask & earlier > 0")} as redundant,
                {counted("n", "mask = bit")} as unique_fails, {counted("good", removed)} as good_lost, {counted("toxic", removed)} as toxic_lost, {counted("n * (120 // greatest(1, bit_count(mask)))", "mask & bit > 0")} as shapley
            from c, s group by part, filter_order, step""",
        "op13_mixing": f"""
            with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, case when source is null then '' else '=' || source end as k, substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as h from documents),
            s as (select k, source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source is null, source) - 1) % 3 + 1 as w from d group by k, source),
            o as (select *, row_number() over (order by 3.0 * source_size / w, k) as i, cast(sum(3 * source_size) over (order by 3.0 * source_size / w, k) as bigint) as caps, cast(sum(w) over (order by 3.0 * source_size / w, k) as bigint) as ws from s),
            t as (select cast(sum(source_size) as bigint) as words, cast(sum(w) as bigint) as w from s),
            l as (select o.*, (t.words - (o.caps - 3 * o.source_size)) / cast(t.w - (o.ws - o.w) as double) as level from o, t),
            c as (select level from l where 3 * source_size > level * w order by i limit 1),
            g as (select k, source_size, w, case when 3 * source_size <= w * (select level from c) or (select count(*) from c) = 0 then cast(3 * source_size as double) else w * (select level from c) end as target from s),
            q as (select d.doc_id, d.k, d.h, d.size, g.source_size, g.w, g.target, cast(sum(d.size) over (partition by d.k order by d.h, d.doc_id) as bigint) as upto from d join g on d.k = g.k),
            x as (select *, unnest(range(0, greatest(1, cast(ceil(case when source_size = 0 then 1 else target / source_size end) as bigint)))) as copy from q),
            p as (select *, unnest(range(0, greatest(1, cast(ceil(size / {mixing.QUANTUM}.0) as bigint)))) as packet from x),
            f as (select *, least(size, (packet + 1) * {mixing.QUANTUM}) - packet * {mixing.QUANTUM} as words, (copy * source_size + upto - size + least(size, (packet + 1) * {mixing.QUANTUM})) / cast(w as double) as finish from p),
            z as (select *, cast(sum(words) over (order by finish, k, copy, h, doc_id, packet rows unbounded preceding) as bigint) - words as position from f)
            select doc_id, any_value(cast(size as bigint)) as size, any_value(source_size) as source_size, any_value(target) as target, cast(sum(greatest(0, least(words, (select words from t) - position))) as bigint) as taken from z group by doc_id""",
    }
