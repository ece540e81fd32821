"""One query per operator over its whole table, and the SQL that checks it where SQL can say it."""

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from lidarlake.llm import bpe, fingerprints, html_text, jaccard_join, langid, line_dedup, merkle, mixing, ogg, resampling, signature_join, token_counts, warc
from lidarlake.llm.common import table
from lidarlake.session import ship_package

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

LINE_SQL = f"""
with lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (select *, {_LOWER.format(f"trim(line, {_SPACES})")} as k from lines),
shared as (
  select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.*, shared.k is not null and doc_id <> first as lost from keyed left join shared using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
"""


@query("op5_line_dedup", LINE_SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


MIX_SQL = f"""
with sizes as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as shuffle,
    coalesce(len({_WORDS.format("text")}), 0)::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size, (array[5, 2, 1])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sizes group by source
), filled as (select *, 3.0::double * source_size / weight as full_at, sum(source_size) over () as total from per),
levels as (
  select *, (total - coalesce(sum(3 * source_size) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following)::double as level from filled
), chosen as (select arg_min(level, full_at) filter (where level <= full_at) as level from levels),
targets as (
  select source, source_size, least(3.0::double * source_size, coalesce(c.level * weight, 3.0::double * source_size))::double as target
  from per, chosen c
), queue as (
  select s.*, t.source_size, t.target, floor(t.target)::bigint as met, copy,
    copy * t.source_size + (sum(size) over (partition by s.source, copy order by shuffle, doc_id rows unbounded preceding))::bigint - size as start
  from sizes s join targets t on s.source is not distinct from t.source, (select unnest([0, 1, 2]) as copy)
), ends as (
  select *, unnest(case when start < met and met < start + size then [met, start + size] else [start + size] end) as stop,
    unnest(case when start < met and met < start + size then [0, 1] else [0] end) as piece from queue where target > 0
), entries as (select *, stop - case when piece = 0 then start else met end as words, stop / target as finish from ends),
summed as (
  select *, sum(words) over (order by finish, shuffle, doc_id, size, copy, piece rows unbounded preceding) as used from entries
), taken as (
  select doc_id, sum(words)::bigint as taken from summed where used <= (select sum(size) from sizes) group by doc_id
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from sizes join targets on sizes.source is not distinct from targets.source left join taken using (doc_id)
"""


@query("op4_mixing", MIX_SQL)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_ogg")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ogg.read_media(ogg.store_text(docs)).drop("error")


@query("op10_token_counts")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_bpe")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op2_langid")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sample = langid.labelled_sample(docs)
    rows = docs.select("doc_id", "text", langid.hold_out().alias("held_out"))
    return langid.predict_language(rows, sample).select("doc_id", "held_out", "lang_pred", "score")


JACCARD_SQL = f"""
with recursive words as (
  select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id
  where 100 * c >= 75 * (x.n + y.n - c)
), edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as least from documents union select e.b, r.least from reach r join edges e on e.a = r.doc_id where r.least < e.b)
select documents.doc_id, coalesce(any_value(sizes.n), 0) as n_shingles, min(least) as component_id
from documents join reach using (doc_id) left join sizes using (doc_id) group by documents.doc_id
"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similarity_components(docs)


LINKS_SQL = JACCARD_SQL[: JACCARD_SQL.index("), edges as (")].replace("with recursive", "with") + """)
select documents.doc_id, count(a) as n_links from documents left join links on documents.doc_id in (a, b) group by documents.doc_id
"""


@query("jaccard_links", LINKS_SQL)
def jaccard_links(spark, sf_dir):
    """The links that op3 leaves uncompared within a component, counted per document."""
    return jaccard_join.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_fingerprints")
def op1(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_warc")
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = warc.derivatives(warc.page_responses(pages))
    return rows.select(*[c for c in rows.columns if c not in ("record", "error")], F.sha2("record", 256).alias("record_sha256"))


@query("op7_html_text")
def op7(spark, sf_dir):
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Checksum of a text's bytes, by a table that the rule of CRC-32 gives.
_CRC_TABLE = """crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as crc
  from range(256) t(i)
)"""
_CRC = """xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: ('0x' || b)::bigint),
  lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295::bigint))"""

_FIELD = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars"))) + " || " + _FIELD + ")"
_LEVELS = """{0}(tree, level, pos, n, h, kids) as (
  select tree, 0, pos, n, h, null::varchar[] from {1}
  union all
  select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)), list(h order by pos)
  from {0} where n > 1 group by tree, level, pos // 8, n
)"""
_CLIMB = """{0}(doc_id, tree, level, pos, n, h, proof) as (
  select doc_id, tree, 0, pos, n, h, proof from {1}
  union all
  select c.doc_id, c.tree, c.level + 1, p.pos, p.n,
    sha256(array_to_string(list_concat(kids[1:c.pos % 8], [c.h], kids[c.pos % 8 + 2:]), '')),
    proof || array_to_string(list_concat(kids[1:c.pos % 8], kids[c.pos % 8 + 2:]), '')
  from {0} c join {2} p on p.tree = c.tree and p.level = c.level + 1 and p.pos = c.pos // 8 where c.n > 1
)"""
MERKLE_SQL = f"""
with recursive {_CRC_TABLE}, leaves as (
  select doc_id, coalesce('=' || lang, '-') as tree, row_number() over (partition by lang order by doc_id) - 1 as pos,
    count(*) over (partition by lang) as n, {_LEAF.format("text")} as h, ({_CRC.format("doc_id::varchar")}) % 3 = 0 as tampered,
    {_LEAF.format(_LOWER.format("text"))} as altered
  from documents, crc_table
), {_LEVELS.format("nodes", "leaves")},
subroots as (
  select tree as name, '#' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n, h from nodes where nodes.n = 1
), {_LEVELS.format("tops", "subroots")},
starts as (select doc_id, tree, pos, n, case when tampered then altered else h end as h, '' as proof from leaves),
{_CLIMB.format("inner_climb", "starts", "nodes")},
middles as (
  select c.doc_id, s.tree, s.pos, s.n, c.h, c.proof from inner_climb c join subroots s on s.name = c.tree where c.n = 1
), {_CLIMB.format("outer_climb", "middles", "tops")}
select leaves.doc_id, leaves.h as leaf, subroots.h as subroot, tops.h as root, sha256(c.proof) as proof_sha256, c.h as folded_root,
  c.h = tops.h as verified
from leaves join subroots on leaves.tree = subroots.name join outer_climb c on c.doc_id = leaves.doc_id and c.n = 1, tops where tops.n = 1
"""


@query("op12_merkle", MERKLE_SQL)
def op12(spark, sf_dir):
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


_ASCII_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FEATURES = f"""select {{0}} as id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f
  from (select {{0}}, {_ASCII_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from {{1}})"""
RESAMPLING_SQL = f"""
with {_CRC_TABLE}, own as ({_FEATURES.format("doc_id", "documents")}), aim as ({_FEATURES.format("item_id", "benchmark")}),
names as (select f, ({_CRC.format("f")}) % 10000 as bucket from (select f from own union select f from aim), crc_table),
own_counts as (select bucket, count(*) as s from own join names using (f) group by bucket),
aim_counts as (select bucket, count(*) as t from aim join names using (f) group by bucket),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from own) + 10000)
    / ((s + 1)::double * ((select count(*) from aim) + 10000))))::bigint as gain
  from own_counts left join aim_counts using (bucket)
), weighed as (
  select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from own join names using (f) join gains using (bucket) group by id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score,
    coalesce(n_features, 0) >= 39 as may
  from documents left join weighed on id = doc_id
), ranked as (
  select *, row_number() over (partition by may order by score desc, doc_id) as place, count(*) filter (where may) over () as n from scored
)
select doc_id, n_features, weight, score, case when may and place <= 25 * n // 100 then place end as rank from ranked
"""


@query("op11_resampling", RESAMPLING_SQL)
def op11(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


NEAR_SQL = JACCARD_SQL.replace(">= 75 *", ">= 85 *").replace("min(least) as component_id", "min(least) as component_id, documents.doc_id = min(least) as kept")


@query("op13_signature_join", NEAR_SQL)
def op13(spark, sf_dir):
    return signature_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
