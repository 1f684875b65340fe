"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, cotraining, decontaminate, jaccard_join, line_dedup, minhash, piece_tokens, quality_rules, ranked_search, sharding, token_files, url_filter, warc
from .shared import new_folder, table, written


#: The url rules of the query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: A host with one of these as a label is listed, with all its paths.
LISTED_LABELS = ["spam-farm", "casino", "adult"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is that of the corpus's host and path keys under listed labels; a key is judged by the cascade."""
    pages = table(spark, sf_dir, "pages")
    key = F.when(F.col("host") != "", F.concat("host", "path"))
    host = url_filter.host_of(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS]))).select(F.concat(host, url_filter.path_of(F.col("url"))).alias("key")).distinct()
    return url_filter.judged_urls(pages, RULES, listed, key)


OP1 = """
with parts as (
  select page_id,
    case when position('://' in coalesce(url, '')) = 0 then '' else substr(url, position('://' in url) + 3) end as rest
  from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
ruled as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule,
    list_has_any(string_split(host, '.'), ['spam-farm', 'casino', 'adult']) as listed
  from split)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict,
  case when host <> '' then host || path end as key, listed
from ruled
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


OP5 = """
with lines as (
  select doc_id, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place
  from documents),
wordy as (select *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') as wordy from lines),
counted as (select site, line, count(distinct doc_id) as n from wordy where wordy group by 1, 2),
total as (select coalesce(source, '') as site, count(*) as total from documents group by 1),
frequent as (select site, line from counted join total using (site) where n >= 5 and n > total * 0.1),
marked as (select w.*, w.wordy and f.line is not null as dropped from wordy w left join frequent f on w.site = f.site and w.line = f.line),
joined as (select doc_id, coalesce(string_agg(line, chr(10) order by place) filter (where not dropped), '') as text, count(*) filter (where dropped) as n_dropped from marked group by 1)
select d.doc_id, j.text, coalesce(j.n_dropped, 0) as n_dropped from documents d left join joined j using (doc_id)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assigned(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    sums = written(token_files.document_sums(spark, path), "sums")  # read twice
    return token_files.with_starts(sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def piece_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of what they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_tokens.with_decoded(piece_tokens.with_piece_ids(docs.select("doc_id", "text"), model).select("doc_id", "ids"), model)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.repair_report(given, conversations.damaged(given))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.minhash_classes(table(spark, sf_dir, "documents"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def classes_sql(size: int, percent: int, more: str = "") -> str:
    """Classes of documents by exact Jaccard similarity of their word shingles."""
    return f"""
with recursive toks as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{a_z}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) >= {size} then list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from toks),
sizes as (select doc_id, len(s) as n from sets),
rows as (select doc_id, unnest(s) as g from sets),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n_both from rows x join rows y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= {percent} * (x.n + y.n - n_both)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from sizes union select reach.doc_id, ways.b from reach join ways on reach.r = ways.a)
select doc_id, any_value(n) as n_shingles, min(r) as component_id{more} from reach join sizes using (doc_id) group by 1
"""


OP3, OP13 = classes_sql(5, 80), classes_sql(3, 85, ", doc_id = min(r) as kept")

LETTERS = f"regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{a_z}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
with toks as (select doc_id, {LETTERS} as w from documents),
items as (select cast(item_id as varchar) as item_id, {LETTERS} as w from benchmark),
windows as (select item_id, least(13, len(w)) as k, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) as g from items where len(w) > 0),
places as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from toks, (select distinct k from windows)),
hits as (select distinct doc_id, i, k, item_id from (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from places) join windows using (k, g)),
words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hits) group by 1),
named as (select doc_id, list_sort(list(distinct item_id)) as ids from hits where item_id is not null group by 1)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_hit, coalesce(len(ids), 0) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
  coalesce(n, 0) > 0 and 20 * coalesce(n, 0) >= len(w) as contaminated
from toks left join words using (doc_id) left join named using (doc_id)
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as hex, min(page_id) over (partition by html) as least from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
  case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to
from h
"""

OP11 = f"""
with words as (select doc_id, unnest({LETTERS}) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by 1, 2),
n as (select doc_id, count(*) as n from words group by 1),
t as (select count(*) as n_docs, cast(sum(n) as bigint) as length from n),
asked as (select distinct item_id, unnest({LETTERS}) as term from benchmark),
df as (select term, count(*) as df from tf where term in (select term from asked) group by 1),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from df, t),
m as (select doc_id, 100 - 90 + (90 * n * n_docs) // length as m from n, t),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join w using (term) join tf using (term) join m using (doc_id) group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 10
"""



def conversation_sql() -> str:
    """Repair by recursion over rows: the least (cost, audit) of each role state, edits as a table of moves."""
    after, kept, named = {"b": "u", "s": "u", "u": "a", "a": "u"}, {("b", "s"): "s", ("b", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, {"u": "user", "a": "assistant"}
    moves = []
    for start in "bsua":
        state, put = start, ""
        for n in range(3):
            seg = "I" * n
            moves.append((start, "", f"{seg}D", 2 * n + 3, state, put, ""))
            moves += [(start, c, f"{seg}K", 2 * n, to, put, "") for (q, c), to in kept.items() if q == state]
            moves.append((start, "", f"{seg}R", 2 * n + 2, after[state], put, named[after[state]]))
            state = after[state]
            put += f"{named[state]}:|"
    rows = ", ".join(str(m).replace("|", "' || chr(10) || '") for m in moves)
    return f"""
with recursive keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
coded as (select *, xor(4294967295, list_reduce(list_transform(range(1, len(k) + 1), lambda i: cast(ascii(substr(k, cast(i as int), 1)) as bigint)),
  lambda c, b: list_reduce(range(8), lambda x, j: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), cast(4294967295 as bigint))) % 20 as kind from keyed),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case when kind = 3 then 2 else 1 end)) as copy from coded where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as ending from damaged),
faulty as (select *, left(role, 1) as initial, ending = '' as blank, ending <> '' and again > 1 as twice, ending <> '' and again = 1 and ending not in ('.', '!', '?') as cut,
  lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
moves as (select * from (values {rows}) as m(source, need, seg, price, target, put, named)),
dp as (select distinct conv_id, cast(0 as bigint) as i, 'b' as state, {{'c': cast(0 as bigint), 'a': '', 'o': ''}} as best from faulty
  union all
  select f.conv_id, f.i, target, min({{'c': best.c + price + case when cut and right(seg, 1) <> 'D' then 1 else 0 end, 'a': best.a || seg,
      'o': best.o || put || case right(seg, 1) when 'K' then role || ':' || text || chr(10) when 'R' then named || ':' || text || chr(10) else '' end}})
  from dp join faulty f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1 join moves on source = state and need in ('', initial) and (right(seg, 1) = 'D' or not (blank or twice)) group by 1, 2, 3),
ends as (select * from (values ('b', '', 0, ''), ('a', '', 0, ''), ('u', 'I', 2, 'assistant:' || chr(10)), ('s', 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10))) as e(state, tail, price, put)),
summed as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (twice) as duplicate, count(*) filter (cut) as truncated,
  count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from faulty group by 1),
done as (select dp.conv_id, min({{'c': best.c + price, 'a': best.a || tail, 'o': best.o || put}}) as best from dp join summed s on s.conv_id is not distinct from dp.conv_id and s.n = dp.i join ends using (state) group by 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(left(best.o, len(best.o) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join summed s on s.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_cotraining": op8_cotraining,
    "op9_token_files": op9_token_files,
    "op10_piece_tokens": op10_piece_tokens,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLES: dict[str, str] = {"op1_url_filter": OP1, "op3_jaccard_join": OP3, "op4_decontaminate": OP4, "op5_line_dedup": OP5, "op6_warc": OP6, "op11_ranked_search": OP11, "op12_conversation_repair": conversation_sql(), "op13_minhash_dedup": OP13}
