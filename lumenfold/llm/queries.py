"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import chat, decontaminate, embeddings, langid, licenses, lm_score, merkle, minhash, mixing, phrases, pii, quality, secret_scan
from lumenfold.llm._shared import crc_mod, table


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", ~lm_score.held_out())
    return lm_score.score_documents(docs).withColumn("held_out", lm_score.held_out())


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marker = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marker).alias("text"))
    out = chat.format_chats(rows.unionByName(added)).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(read).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        _sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _sha(F.array_join("items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_mod("doc_id", 4) == 2
    training = docs.where(~out).select("lang", "text", F.xxhash64("doc_id").alias("pick"))
    return langid.identify(docs, langid.dictionaries(training)).withColumn("held_out", F.coalesce(out, F.lit(False)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs, weights, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, pii.KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    count = [number(kind) for kind in pii.BASE]
    return found.select("doc_id", *count, _sha(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, secret_scan.KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *(number(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS)), _sha(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = merkle.document_leaves(table(spark, sf_dir, "documents"), tampered)
    proved = merkle.manifest(leaves, "source", ["doc_id"], "leaf", "claimed")
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_source_mix": op3_source_mix,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_secret_scan": op11_secret_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrases": op13_phrases,
}

_LOW = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_TOKENS = rf"regexp_extract_all({_LOW}, '{decontaminate.TOKEN}')"
_ESCAPED = "(length({0}) + 4*(length({0})-length(replace({0},'&',''))) + 3*(length({0})-length(replace({0},'<',''))) + 5*(length({0})-length(replace({0},'[',''))))"
#: crc32 of the decimal id, bit by bit; a document's leaf
_CRC = "list_reduce(list_prepend(4294967295::bigint, [ord(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
_TAMPERED = f"case when doc_id is not null and xor({_CRC}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end"
_FIELD = "coalesce(octet_length(encode(({0})::varchar))::varchar || ':' || ({0})::varchar, '-')"
_LEAF = "sha256(" + " || ".join([*(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")), _FIELD]) + ")"

SQL: dict[str, str] = {
    "op1_minhash_dedup": rf"""with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') w from documents),
 s as (select doc_id, case when len(w)=0 then [] when len(w)<5 then [array_to_string(w,' ')] else list_distinct([array_to_string(w[i:i+4],' ') for i in range(1,len(w)-3)]) end s from w),
 x as (select doc_id, unnest(s) g from s), p as (select a.doc_id a, b.doc_id b, count(*) k from x a join x b on a.g=b.g and a.doc_id<>b.doc_id group by 1,2),
 e as (select a, b from p join s na on na.doc_id=a join s nb on nb.doc_id=b where 100*k >= 75*(len(na.s)+len(nb.s)-k)),
 r(a, b) as (select doc_id, doc_id from s union select r.a, e.b from r join e on e.a=r.b), c as (select a, min(b) component_id from r group by 1)
 select doc_id, len(s)::bigint n_shingles, component_id, doc_id = component_id kept from s join c on c.a = doc_id""",
    "op4_chat_format": f"""with c as (select conv_id, turn, coalesce(role,'') r, coalesce(text,'') t from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 select conv_id, count(*) n_turns, sha256(string_agg(r||chr(10)||t||chr(10),'' order by turn,r,t)) turns_sha256, cast(coalesce(sum(length(t)) filter (where r='assistant'),0) as bigint) loss_chars,
 sha256(coalesce(string_agg(t,'' order by turn,r,t) filter (where r='assistant'),'')) loss_sha256, cast(sum(24 + {_ESCAPED.format('r')} + {_ESCAPED.format('t')}) as bigint) formatted_chars from c group by 1""",
    "op5_decontaminate": f"""with d as (select doc_id, {_TOKENS} w from documents), b as (select item_id, {_TOKENS} w from benchmark),
 bw as (select distinct item_id, least(len(w),10) n, array_to_string(w[i:i+least(len(w),10)-1],' ') g from b, lateral (select unnest(range(1,len(w)-least(len(w),10)+2)) i) where len(w)>0), ns as (select distinct n from bw),
 dw as (select doc_id, n, i, array_to_string(w[i:i+n-1],' ') g from d, ns, lateral (select unnest(range(1,len(w)-n+2)) i) where len(w)>=n), h as (select doc_id, i, n, item_id from dw join bw using (n,g)),
 hit as (select doc_id, count(distinct p) n_hit from h, lateral (select unnest(range(i,i+n)) p) group by 1),
 it as (select doc_id, count(*) n_items, string_agg(v, ',' order by v) v from (select distinct doc_id, item_id::varchar v from h) group by 1)
 select doc_id, len(w)::bigint n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items, sha256(coalesce(v,'')) items_sha256, coalesce(n_hit,0)>0 contaminated from d left join hit using (doc_id) left join it using (doc_id)""",
    "op6_embedding_dedup": """with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
 l as (select a.vec_id a, b.vec_id b from v a join v b on a.label=b.label and a.vec_id<>b.vec_id where list_cosine_similarity(a.e,b.e) >= 0.98),
 r(a, b) as (select vec_id, vec_id from v union select r.a, l.b from r join l on l.a=r.b), c as (select a, min(b) component_id from r group by 1), n as (select a, count(*) n from l group by 1)
 select vec_id, coalesce(n.n,0) n_links, component_id, vec_id = component_id kept from v join c on c.a=vec_id left join n on n.a=vec_id""",
    "op12_merkle_manifest": f"""with recursive d as (select doc_id, source, {_LEAF.format('text')} leaf, {_LEAF.format(_TAMPERED)} claimed from documents),
 p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from d),
 t(lv, source, pos, n, h) as (select 0, source, pos, n, leaf from p union all select lv+1, source, pos//3, (n+2)//3, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by lv, source, pos//3, n),
 s as (select source, row_number() over (order by source nulls first) - 1 pos, count(*) over () n, h subroot from t where n = 1),
 u(lv, pos, n, h) as (select 0, pos, n, subroot from s union all select lv+1, pos//3, (n+2)//3, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by lv, pos//3, n),
 tr as (select lv, source, pos//3 run, list(h order by pos) hs from t where n > 1 group by all), ur as (select lv, pos//3 run, list(h order by pos) hs from u where n > 1 group by all),
 f(doc_id, leaf, source, place, lv, pos, h, sib) as (select doc_id, leaf, source, pos, 0, pos, claimed, '' from p
  union all select f.doc_id, f.leaf, f.source, f.place, f.lv+1, f.pos//3, sha256(array_to_string(hs[:f.pos%3],'')||f.h||array_to_string(hs[f.pos%3+2:],'')), f.sib||array_to_string(hs[:f.pos%3],'')||array_to_string(hs[f.pos%3+2:],'') from f join tr on tr.lv=f.lv and tr.source is not distinct from f.source and tr.run=f.pos//3),
 top as (select f.doc_id, f.leaf, f.source, f.place, max_by(f.h, f.lv) h, max_by(f.sib, f.lv) sib from f group by all),
 g(doc_id, leaf, source, place, subroot, lv, pos, h, sib) as (select top.doc_id, top.leaf, top.source, top.place, s.subroot, 0, s.pos, top.h, top.sib from top join s on s.source is not distinct from top.source
  union all select g.doc_id, g.leaf, g.source, g.place, g.subroot, g.lv+1, g.pos//3, sha256(array_to_string(hs[:g.pos%3],'')||g.h||array_to_string(hs[g.pos%3+2:],'')), g.sib||array_to_string(hs[:g.pos%3],'')||array_to_string(hs[g.pos%3+2:],'') from g join ur on ur.lv=g.lv and ur.run=g.pos//3)
 select doc_id, leaf, subroot, (select h from u where n = 1) root, sha256(max_by(sib, lv)) proof_sha256, max_by(h, lv) folded_root, max_by(h, lv) = (select h from u where n = 1) verified from g group by doc_id, leaf, source, place, subroot""",
    "op13_phrases": rf"""with t as (select coalesce(lang,'und') lang, {_LOW} t from documents), pc as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) p from t),
 w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pc), nn as (select lang, sum(len(w))::bigint n from w group by 1),
 g as (select lang, k, unnest([array_to_string(w[i:i+k-1],' ') for i in range(1, len(w)-k+2)]) phrase from w, (select unnest([1,2,3,4]) k) where len(w) >= k),
 f as (select lang, k, phrase, count(*) f from g group by all having count(*) >= 30), c as (select lang, phrase, k, f a, string_split(phrase,' ') w from f where k > 1),
 x as (select lang, phrase, a, j, array_to_string(w[:j],' ') p1, array_to_string(w[j+1:],' ') p2 from c, (select unnest([1,2,3]) j) where j < k),
 y as (select x.lang, x.phrase, a, j, f1.f l, f2.f r, ((2000000::hugeint*a)//(f1.f::hugeint+f2.f))::bigint score from x join f f1 on f1.lang=x.lang and f1.phrase=p1 join f f2 on f2.lang=x.lang and f2.phrase=p2),
 b as (select lang, phrase, a, l, r, score from y qualify row_number() over (partition by lang, phrase order by score, j) = 1),
 i as (select lang, array_to_string(w[s:s+m-1],' ') phrase, max(a) longer from c, (select unnest([2,3]) m), (select unnest([1,2,3]) s) where m < k and s+m-1 <= k group by all),
 z as (select b.* from b left join i using (lang, phrase) where longer is null or 100*longer::hugeint < 80*a::hugeint)
 select z.lang, row_number() over (partition by z.lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score from z join nn on nn.lang=z.lang qualify row_number() over (partition by z.lang order by score desc, a desc, phrase) <= 2000""",
}
