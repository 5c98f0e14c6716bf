"""A query for each group of operators over the shared tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.functions import countries as K
from codexlake.functions import nested as N
from codexlake.functions import text as T
from codexlake.functions import vectors as V
from codexlake.operators import clusters as C
from codexlake.operators import diagnostics as D
from codexlake.operators import filters as P
from codexlake.operators import reduction as M
from codexlake.operators import responses as R
from codexlake.operators import statistics as S
from codexlake.operators import tables as A
from codexlake.operators import topics as O
from codexlake.session import ship
from codexlake.sources import readers as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = "", name: str = ""):
    def keep(f: Callable[[Callable[..., DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda table, *columns: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns or "*"))

        QUERIES[name or f.__name__] = run
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def alternatives(patterns: list[str]) -> str:
    return "|".join(patterns).replace("'", "''")


GARBAGE = f"regexp_matches(text, '(?i){alternatives(T.GARBAGE_PATTERNS)}')"
MARKUP = "(regexp_matches(text, '<[a-zA-Z]') or (contains(text, '&') and contains(text, ';')))"
PRIVATE = "regexp_matches(text, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]')"


# --- screening -------------------------------------------------------------------------------------------------------------------


#: documents with what each rule looks for, by doc_id.
SQL_SPOILED = """select doc_id, lang, text || case doc_id % 7 when 0 then ' Get e-Alerts' when 1 then ' <b>x' when 2 then ' &amp; x;' when 3 then chr(57345) else '' end
as text from documents"""


def spoiled(t):
    k = F.col("doc_id") % 7
    end = F.when(k == 0, " Get e-Alerts").when(k == 1, " <b>x").when(k == 2, " &amp; x;").when(k == 3, "").otherwise("")
    return t("documents", "doc_id", "text", "lang").withColumn("text", F.concat("text", end))


@query(f"""with p as ({SQL_SPOILED}), f as (select doc_id, coalesce(lang, '') <> 'en' a, coalesce(length(text), 0) < 500 b, coalesce({GARBAGE}, false) c,
coalesce({MARKUP}, false) d, coalesce({PRIVATE}, false) e from p),
r as (select doc_id, concat_ws(' | ', case when a then 'language' end, case when b then 'short' end, case when c then 'boilerplate' end, case when d then 'markup' end,
case when e then 'characters' end) reason from f)
select doc_id, reason, case when reason = '' then 'APPROVED' else 'REJECTED' end decision from r""")
def screening_cascade(t):
    x = F.col("text")
    rules = [(F.coalesce(F.col("lang"), F.lit("")) != "en", "language"), (F.coalesce(F.length(x), F.lit(0)) < 500, "short"), (T.has_garbage(x), "boilerplate"), (T.has_markup(x), "markup"), (T.has_private_characters(x), "characters")]
    return P.decided(spoiled(t), *rules).select("doc_id", "reason", "decision")


@query("""select doc_id, coalesce(type in ('article', 'book') and lang = 'en' and title <> '' and length(title || '. ' || text) >= 500, false) complete
from (select *, 'article' as type, left(text, 20) title from documents)""")
def complete_works(t):
    return t("documents", "doc_id", "text", "lang").select("doc_id", P.complete(F.substring("text", 1, 20), F.col("text"), F.lit("article"), F.col("lang")).alias("complete"))


@query("""with w as (select doc_id, text, regexp_extract_all(lower(text), '[a-z'']+') w from documents)
select doc_id, (len(w) > 10 and not list_has_any(w, ['the', 'and', 'of', 'is', 'to', 'in', 'that', 'it', 'with', 'as', 'for', 'was']))
 or (case when length(text) > 0 then length(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g')) / length(text) else 0 end) > 0.15 suspicious from w""")
def suspicious_language(t):
    return t("documents", "doc_id", "text").select("doc_id", T.suspicious_english(F.col("text")).alias("suspicious"))


def sql_foreign(x: str) -> str:
    """The stop-word vote against English, on an expression."""
    words, known = f"regexp_extract_all(lower({x}), '[a-z'']+')", ", ".join(f"'{w}'" for w in T.ENGLISH_STOPWORDS)
    return f"((len({words}) > 10 and not list_has_any({words}, [{known}])) or (case when length({x}) > 0 then length(regexp_replace({x}, '[\\x00-\\x7F]+', '', 'g')) / length({x}) else 0 end) > 0.15)"


SQL_SENTENCES = r"[z for z in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if z <> '']"


@query(f"""with s as (select doc_id, left(text, 80) c, {SQL_SENTENCES} s from documents), f as (select doc_id, c, [{sql_foreign('z')} for z in s] every,
[cast({sql_foreign('z')} as int) for z in s if length(trim(z)) >= 5] b from s)
select doc_id, coalesce(trim(c) <> '' and length(c) >= 5 and not {sql_foreign('c')}, false) title, coalesce(list_sum(b) / nullif(len(b), 0) < 0.2, true) share,
coalesce(list_sum(b) / nullif(len(b), 0) < 0.2, false) share_strict,
coalesce(len([k for k in range(1, len(b) + 1) if list_sum(b[1:k]) / k >= 0.2]) = 0, false) prefixes, not list_contains(every, true) as "every" from f""")
def sentence_language(t):
    x = F.col("text")
    return t("documents", "doc_id", "text").select("doc_id", P.english_title(F.substring(x, 1, 80)).alias("title"), P.english_abstract(x).alias("share"), P.english_abstract(x, empty_passes=False).alias("share_strict"), P.english_prefixes(x).alias("prefixes"), P.every_sentence_english(x).alias("every"))


@query("""with p as (select doc_id, case doc_id % 9 when 0 then '<jats:p>' || text when 1 then 'Purchase this article ' || text when 2 then 'https://doi.org/10.1000/x '
|| text when 3 then 'Volume 3, Issue 4 ' || text when 4 then 'ISSN 1234-567x ' || text when 5 then '© 2020 some publisher name' when 6 then text || ' Share on Twitter'
else text end as text from documents), n as (select doc_id, lower(text) t, text from p) select doc_id,
case """ + " ".join(f"when contains(t, '{m}') then 'JATS/HTML Tag Found (''{m}'')'" for m in T.MARKUP_MARKS) + " " + " ".join(f"when contains(t, '{m}') then '{r}'" for m, r in T.PAYWALL_MARKS.items()) + r"""
when regexp_matches(text, '^.{0,150}https?://doi\.org/10\.\d{4,}') then 'Early DOI Redirection Link' when regexp_matches(t,
'^(volume|vol\.?)\s+\d+,\s+(issue|iss\.?)\s+\d+') then 'Volume/Issue Header Residual'
when regexp_matches(t, '(online issn|print issn|issn[:\s])\s*\d{4}-\d{3}[\dx]') then 'ISSN Header Noise' when regexp_matches(t, '^©\s+\d{4}\s+[a-z][a-za-z\s]{3,60}$')
then 'Pure Copyright Line Abstract' else 'Passed' end reason from n""")
def paywall_scan(t):
    k, x = F.col("doc_id") % 9, F.col("text")
    put = lambda head: F.concat(F.lit(head), x)
    changed = F.when(k == 0, put("<jats:p>")).when(k == 1, put("Purchase this article ")).when(k == 2, put("https://doi.org/10.1000/x ")).when(k == 3, put("Volume 3, Issue 4 ")).when(k == 4, put("ISSN 1234-567x ")).when(k == 5, "© 2020 some publisher name").when(k == 6, F.concat(x, F.lit(" Share on Twitter"))).otherwise(x)
    return t("documents", "doc_id", "text").withColumn("text", changed).select("doc_id", T.paywall_reason(x).alias("reason"))


@query(f"""with p as (select page_id, html || case page_id % 3 when 0 then ' Share on Facebook' when 1 then ' PubMed and Google Scholar, pubmed' else '' end html from
pages)
select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(html), '({alternatives(T.NOISE_PATTERNS)})'))), ', ') noises from p""")
def noise_scan(t):
    k = F.col("page_id") % 3
    html = F.concat("html", F.when(k == 0, " Share on Facebook").when(k == 1, " PubMed and Google Scholar, pubmed").otherwise(""))
    return t("pages", "page_id", "html").select("page_id", F.array_join(T.noise_found(html), ", ").alias("noises"))


@query("""with k as (select *, md5(lower(trim(text))) h from documents) select doc_id from (select doc_id, row_number() over (partition by h order by doc_id) r from k)
where r = 1""")
def keep_first_content(t):
    return P.keep_first(t("documents", "doc_id", "text").withColumn("h", T.content_hash(F.col("text"))), F.col("h"), "doc_id").select("doc_id")


@query("""select doc_id, count(*) over (partition by text) copies from documents""")
def collision_counts(t):
    return P.collisions(t("documents", "doc_id", "text"), F.md5("text")).select("doc_id", "copies")


@query("""select md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) "group", count(*) n, array_to_string(list(doc_id order by doc_id), ',') "keys" from documents
where text is not null group by 1 having count(*) > 1""")
def duplicate_groups(t):
    d = D.duplicate_groups(t("documents", "doc_id", "text"), F.col("doc_id"), F.col("text"))
    return d.select("group", "n", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"))


@query("""select p_partkey, concat_ws(', ', case when p_size > 40 then 'size' end, case when p_brand = 'Brand#11' then 'brand' end) missing from part where p_size > 40 or
p_brand = 'Brand#11'""")
def missing_metadata(t):
    p = t("part", "p_partkey", "p_size", "p_brand")
    gaps = P.missing_fields(size=F.when(F.col("p_size") <= 40, F.lit("x")), brand=F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")))
    return p.withColumn("gaps", gaps).filter(F.size("gaps") > 0).select("p_partkey", F.array_join("gaps", ", ").alias("missing"))


@query("""select count(*) n from documents where not (regexp_matches(coalesce(text, ''), '(?i)\\bnan\\b') or regexp_matches(coalesce(lang, ''), '(?i)\\bnan\\b') or
regexp_matches(coalesce(source, ''), '(?i)\\bnan\\b'))""")
def rows_without_nan(t):
    return P.without_nan_text(t("documents", "text", "lang", "source")).agg(F.count(F.lit(1)).alias("n"))


@query("""with w as (select doc_id, unnest(regexp_extract_all(regexp_replace(text || case doc_id % 4 when 0 then ' an exam-ple to co- operate' when 1 then ' exam' ||
chr(173) || ' ple' else ' well-known' end, chr(173) || '\\s*', '-', 'g'), '\\b[a-zA-Z]{2,}-\\s*[a-zA-Z]{2,}\\b')) x from documents),
d as (select distinct lower(unnest(regexp_extract_all(text, '[a-zA-Z]{2,}'))) w from benchmark union select unnest(['example', 'cooperate', 'well-known', 'wellknown']))
select doc_id, count(*) n from w where lower(regexp_replace(x, '-\\s*', '')) in (select w from d) and lower(x) not in (select w from d) group by doc_id""")
def broken_word_scan(t):
    k = F.col("doc_id") % 4
    d = t("documents", "doc_id", "text").withColumn("text", F.concat("text", F.when(k == 0, " an exam-ple to co- operate").when(k == 1, " exam­ ple").otherwise(" well-known")))
    return P.broken_word_counts(d, "doc_id", "text", dictionary_words(t))


def dictionary_words(t):
    found = F.regexp_extract_all("text", F.lit("[a-zA-Z]{2,}"), F.lit(0))
    return t("benchmark", "text").select(F.explode(F.concat(found, F.array(*map(F.lit, ("example", "cooperate", "well-known", "wellknown"))))).alias("word")).distinct()


@query(f"""with p as ({SQL_SPOILED}), q as (select doc_id, text || case doc_id % 5 when 0 then ' exam-ple of co- operate' else '' end as text from p),
w as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, chr(173) || '\\s*', '-', 'g'), '\\b[a-zA-Z]{{2,}}-\\s*[a-zA-Z]{{2,}}\\b')) x from q),
d as (select distinct lower(unnest(regexp_extract_all(text, '[a-zA-Z]{{2,}}'))) w from benchmark union select unnest(['example', 'cooperate', 'well-known',
'wellknown'])),
b as (select doc_id from w where lower(regexp_replace(x, '-\\s*', '')) in (select w from d) and lower(x) not in (select w from d) group by doc_id having count(*) >= 2)
select doc_id, coalesce(text <> '' and not {GARBAGE} and not {MARKUP} and not {PRIVATE}, false) and doc_id not in (select doc_id from b) well_formed from q""")
def format_gate(t):
    d = spoiled(t).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 5 == 0, " exam-ple of co- operate").otherwise("")))
    return P.well_formed(d, "doc_id", "text", dictionary_words(t)).select("doc_id", "well_formed")


@query("""with d as (select doc_id, nullif(left(text, 3), 'The') title, text, case when doc_id % 10 <> 0 then source end source from documents), m as (select *,
concat_ws(', ', case when coalesce(trim(title) = '', true) then 'title' end, case when coalesce(trim(text) = '', true) then 'abstract' end, case when
coalesce(trim(source) = '', true) then 'authors' end) gaps from d),
c as (select *, count(*) filter (gaps = '') over (partition by text) n from m), r as (select doc_id, case when gaps <> '' then 'missing: ' || gaps when n > 1 then
'duplicate abstract' else '' end reason from c)
select doc_id, reason, case when reason = '' then 'APPROVED' else 'REJECTED' end decision from r""")
def hard_rule_split(t):
    d = t("documents", "doc_id", "text", "source").withColumns({"title": F.nullif(F.substring("text", 1, 3), F.lit("The")), "authors": F.when(F.col("doc_id") % 10 != 0, F.col("source"))})
    return P.hard_rules(d, "title", "text", "authors").select("doc_id", "reason", "decision")


@query(f"""with s as (select doc_id, {SQL_SENTENCES} s, case when doc_id % 5 = 4 then null else (doc_id % 5) / 4.0 end m from documents), b as (select *,
[cast({sql_foreign('z')} as int) for z in s if length(trim(z)) >= 5] b from s),
e as (select *, coalesce(len([k for k in range(1, len(b) + 1) if list_sum(b[1:k]) / k >= 0.2]) = 0, false) e from b)
select doc_id, case when e and coalesce(m >= 0.5, true) then 'APPROVED' else 'REJECTED' end decision, case when not e then
'Language check failed (non-English content detected.)' when m is null then 'English detection passed. | not compared.'
when m < 0.5 then 'Matching check failed (Semantic Mismatch: Similarity is ' || printf('%.4f', m) || ' (threshold: 0.50))' else
'English detection passed. | Passed vector verification (similarity: ' || printf('%.4f', m) || ')' end audit_reason from e""")
def rule_filter(t):
    m = F.when(F.col("doc_id") % 5 != 4, (F.col("doc_id") % 5) / 4.0)
    return P.rule_filter(t("documents", "doc_id", "text"), F.col("text"), m).select("doc_id", "decision", "audit_reason")


@query("""select conv_id, turn, case when turn % 4 = 0 then 'APPROVED' else 'REJECTED' end decision, case turn % 4 when 0 then 'fine' when 1 then 'off topic' when 2 then
'No reason provided.' else 'LLM json parse error' end audit_reason from conversations""")
def model_filter(t):
    k = F.col("turn") % 4
    answer = F.when(k == 0, '{"is_english": true, "is_matching": true, "reason": "fine"}').when(k == 1, '{"is_english": true, "is_matching": false, "reason": "off topic"}').when(k == 2, '{"is_english": true}').otherwise("sure, it is")
    return P.model_filter(t("conversations", "conv_id", "turn"), answer).select("conv_id", "turn", "decision", "audit_reason")


@query("""select c_custkey from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0""")
def presence_guard(t):
    c = t("customer", "c_custkey", "c_name").withColumns({"id": F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "text": F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise("x")})
    return P.present(c, "id", "text").select("c_custkey")


@query("""select o_orderkey, cast(2.5 + o_orderkey % 2 as double) relevance from orders where o_orderkey % 3 = 2 and o_orderkey % 5 <> 0""")
def relevant_rows(t):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "x").when(k % 3 == 1, "NaN").otherwise((2.5 + k % 2).cast("string"))
    o = t("orders", "o_orderkey").withColumns({"relevance": T.number(text), "abstract": F.when(k % 5 != 0, "a")})
    return o.filter("relevance is not null and abstract is not null").select("o_orderkey", "relevance")


@query("""select o_orderkey from orders where o_orderpriority not in ('1-URGENT', '5-LOW') and o_orderstatus = 'F'""")
def type_and_flag_filters(t):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "article").when(F.col("o_orderpriority") == "5-LOW", "book").otherwise(F.col("o_orderpriority"))
    flag = F.when(F.col("o_orderstatus") == "F", " true ").otherwise("FALSE")
    return t("orders", "o_orderkey", "o_orderpriority", "o_orderstatus").filter(P.unexpected_type(kind) & P.true_text(flag)).select("o_orderkey")


# --- scalar functions ------------------------------------------------------------------------------------------------------------


@query(r"""select page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) suffix, replace(url, 'https://', '') bare, case when url like 'http%' then
regexp_replace(url, '/+$', '') else 'https://x.org/' || url end full_url, replace(replace(replace(url, '/', '_'), ':', '_'), ' ', '-') file from pages""")
def id_functions(t):
    u = F.col("url")
    return t("pages", "page_id", "url").select("page_id", T.id_suffix(u).alias("suffix"), T.id_without_prefix(u, "https://").alias("bare"), T.id_url(u, "https://x.org/").alias("full_url"), T.file_name(u).alias("file"))


@query(r"""select p_partkey, array_to_string([upper(left(x, 1)) || lower(substr(x, 2)) for x in string_split(replace(p_type, ' ', '-'), '-')], '-') title,
trim(regexp_replace(replace(replace(p_type, ' ', '|,'), '|', ', '), '\s*,\s*', ', ', 'g'), ', ') labels, cast(cast(trunc(p_retailprice) as bigint) as varchar) whole,
regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') norm, md5(lower(trim(p_name))) h, case when trim(p_brand) not in ('', 'nan') then p_brand end brand from part""")
def label_functions(t):
    c = F.col
    return t("part").select("p_partkey", T.hyphen_title(F.replace(c("p_type"), F.lit(" "), F.lit("-"))).alias("title"), T.clean_labels(F.replace(c("p_type"), F.lit(" "), F.lit("|,"))).alias("labels"), T.whole_number_text(c("p_retailprice").cast("string")).alias("whole"), T.normalised(c("p_name")).alias("norm"), T.content_hash(c("p_name")).alias("h"), T.null_marks_as_null(c("p_brand")).alias("brand"))


NAMES = {"BO": "Bolivia, Plurinational State of"}


@query("""select n_nationkey, case n_nationkey % 4 when 0 then 'Germany, United States' when 1 then 'Plurinational State of Bolivia, QQ' when 2 then 'nan' else 'France'
end countries from nation""")
def country_expansion(t):
    n = t("nation", "n_nationkey")
    k = F.col("n_nationkey") % 4
    codes = F.when(k == 0, "DE, US,DE").when(k == 1, "BO, QQ").when(k == 2, " , ").otherwise("FR")
    return n.select("n_nationkey", K.country_names(codes, K.iso_names(n.sparkSession) | NAMES).alias("countries"))


@query("""select doc_id, case when instr(text, '. ') > 0 then left(text, instr(text, '. ') - 1) else left(text, 100) end title, length(case when instr(text, '. ') > 0
then substr(text, instr(text, '. ') + 2) else text end) rest,
round(length(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g')) / length(text), 6) foreign_share from documents where length(text) > 0""")
def combined_text_functions(t):
    d = t("documents", "doc_id", "text").filter("length(text) > 0").withColumn("s", T.split_combined(F.col("text")))
    return d.select("doc_id", "s.title", F.length("s.abstract").cast("bigint").alias("rest"), r6(T.non_ascii_share(F.col("text")), "foreign_share"))


@query(r"""select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) abstract from documents where length(trim(text)) > 0""")
def inverted_index_abstracts(t):
    texts = t("documents", "doc_id", "text").filter("length(trim(text)) > 0")
    return texts.select("doc_id", F.coalesce(N.abstract_text(N.inverted_index(T.collapsed(F.col("text")))), F.lit("")).alias("abstract"))  # blank where all is white space, as in the SQL


@query("""select r_name field, '' topic, cast(s_suppkey as varchar) id, s_name title, 'Hello ' || s_name abstract, s_name authors, 2020 + s_suppkey % 3 publication_year,
case when s_suppkey % 2 = 0 then r_name else n_name end venue, 'article' paper_type, 'journal' venue_type,
case when n_name = r_name then n_name else n_name || '|' || r_name end institutions, 'DE|US' countries, case when s_suppkey % 3 = 0 then '' else 'gold' end
open_access_status, 1 author_count, case when s_suppkey % 5 = 0 then 7 when n_name = r_name then 1 else 2 end institution_count, 1 country_count, cast(s_suppkey * 2 as
bigint) citation_count,
case when s_suppkey % 2 = 0 then '0.5' else '' end citation_percentile from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def work_flattening(t):
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    inst = F.array(*(F.struct(F.col(c).alias("display_name"), F.lit("US").alias("country_code")) for c in ("n_name", "r_name", "n_name")))
    author = F.array(F.struct(F.struct(F.col("s_name").alias("display_name")).alias("author"), F.array(F.lit("DE")).alias("countries"), inst.alias("institutions")))
    place = F.struct(F.when(k % 2 == 0, F.col("r_name")).otherwise("").alias("raw_source_name"), F.struct(F.col("n_name").alias("display_name"), F.lit(" journal ").alias("type")).alias("source"))
    works = s.select(
        F.col("r_name").alias("field"), k.cast("string").alias("id"), F.col("s_name").alias("title"), F.lit("article").alias("type"), F.lit("en").alias("language"), F.create_map(F.lit("Hello"), F.array(F.lit(0)), F.col("s_name"), F.array(F.lit(1))).alias("abstract_inverted_index"),
        (2020 + k % 3).cast("int").alias("publication_year"), (k * 2).cast("bigint").alias("cited_by_count"), place.alias("primary_location"), author.alias("authorships"), F.when(k % 5 == 0, 7).alias("institutions_distinct_count"), F.lit(None).cast("int").alias("countries_distinct_count"),
        F.struct(F.when(k % 2 == 0, 0.5).alias("value")).alias("citation_normalized_percentile"), F.struct(F.lit(True).alias("is_oa"), F.when(k % 3 != 0, "gold").alias("oa_status")).alias("open_access"),
    )
    return N.work_rows(works)


# --- vectors and clusters --------------------------------------------------------------------------------------------------------

SQL_CENTROIDS = """m as (select label, i, avg(cast(x as double)) x, count(*) n from (select label, unnest(range(1, 65)) i, unnest(embedding) x from embeddings) group by
label, i),
l as (select label, sqrt(sum(x * x)) + 1e-12 l, max(n) n from m group by label), c as (select m.label, i, x / l x, l.n from m join l on m.label = l.label)"""


def members(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))


@query(f"with {SQL_CENTROIDS} select label as \"cluster\", cast(i - 1 as int) as \"at\", round(x, 6) x from c")
def cluster_centroids(t):
    return C.centroids(members(t)).select("cluster", F.posexplode("centroid").alias("at", "x")).select("cluster", "at", r6(F.col("x"), "x"))


SQL_SCORES = f"""with {SQL_CENTROIDS}, v as (select vec_id, label, unnest(range(1, 65)) i, cast(unnest(embedding) as double) x from embeddings),
s as (select vec_id, v.label, sum(v.x * c.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(c.x * c.x))) s from v join c on v.label = c.label and v.i = c.i group by vec_id, v.label),
h as (select label, avg(s) coherence from s group by label), o as (select a.label, b.label other, sum(a.x * b.x) s from c a join c b on a.i = b.i and a.label <> b.label
group by a.label, b.label),
d as (select label, 1 - max(s) distinctiveness from o group by label), n as (select label, count(*) n from embeddings group by label)"""


@query(SQL_SCORES + """ select n.label as "cluster", n.n, round(coherence, 6) coherence, round(distinctiveness, 6) distinctiveness, round(coherence * distinctiveness *
sqrt(least(n.n, 2000) / 2000.0), 6) score from n join h on n.label = h.label join d on n.label = d.label""")
def cluster_scores(t):
    return C.scores(members(t)).select("cluster", "n", *(r6(F.col(c), c) for c in ("coherence", "distinctiveness", "score")))


@query(SQL_SCORES + """ select label as "cluster", round(1 - avg(s), 6) distinctiveness
from (select *, row_number() over (partition by label order by s desc, other) r from o) where r <= 3 group by label""")
def cluster_distinctiveness(t):
    return C.distinctiveness(C.centroids(members(t)), 3).select("cluster", r6(F.col("distinctiveness"), "distinctiveness"))


@query(SQL_SCORES + """ select label as "cluster", vec_id id, round(s, 6) similarity, cast(r as int) as rank from (select *, row_number() over (partition by label order
by s desc, vec_id) r from s) where r <= 5""")
def cluster_representatives(t):
    return C.representatives(members(t)).select("cluster", "id", r6(F.col("similarity"), "similarity"), "rank")


@query(SQL_SCORES + """ select label as "cluster", other, round(s, 6) similarity from o""")
def cluster_similarities(t):
    return C.sibling_similarities(C.centroids(members(t))).select("cluster", "other", r6(F.col("similarity"), "similarity"))


@query()
def reduced_clusters(t):
    return M.clustered(members(t).select("id", "vector"), 10).select("id", "cluster")


@query()
def diverse_ranking(t):
    return C.diverse_order(members(t))


@query()
def cluster_merging(t):
    m = members(t).withColumn("vector", V.normalised(F.col("vector"), 1e-12))
    return C.merged_clusters(C.centroids(m), least=0.1, target=4)


@query("""with v as (select vec_id, vec_id % 100 k, unnest(range(1, 65)) i, cast(unnest(embedding) as double) x from embeddings), q as (select * from v where vec_id <
100)
select v.vec_id, round(sum(v.x * q.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(q.x * q.x))), 6) similarity, sum(v.x * q.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(q.x * q.x))) >=
0.5 matching from v join q on v.k = q.vec_id and v.i = q.i group by v.vec_id""")
def semantic_match(t):
    e = t("embeddings", "vec_id", "embedding")
    pairs = e.withColumn("k", F.col("vec_id") % 100).join(e.filter("vec_id < 100").select(F.col("vec_id").alias("k"), F.col("embedding").alias("other")), "k")
    return pairs.select("vec_id", r6(V.cosine(F.col("embedding"), F.col("other")), "similarity"), P.matching(F.col("embedding"), F.col("other")).alias("matching"))


@query(r"""with d as (select source as "cluster", [x for x in regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') if regexp_full_match(x, '[a-zA-Z]{2,}') and x not in
('the', 'of')] w from documents),
g as (select "cluster", array_to_string(w[i:i + k - 1], ' ') term from (select *, unnest(range(1, len(w) - k + 2)) i from d, (select unnest([2, 3, 4]) k))),
b as (select "cluster", term, count(*) n from g group by all), k as (select term, count(*) df, sum(n) total from b group by term having count(*) >= 3 and count(*) <= 0.35
* (select count(distinct "cluster") from d) order by total desc, term limit 100000),
c as (select b."cluster", b.term, n, df from b join k on b.term = k.term), z as (select "cluster", sum(n) size from c group by 1),
w as (select c."cluster", term, cast(n as bigint) n, round(n / (size + 1e-12) * (ln(((select count(distinct "cluster") from d) + 1) / (df + 1)) + 1), 9) weight from c
join z on c."cluster" = z."cluster")
select "cluster", term, n, round(weight, 6) weight from (select *, row_number() over (partition by "cluster" order by weight desc, term) r from w) where r <= 10""")
def class_tfidf(t):
    return C.class_tfidf(t("documents", "source", "text").withColumnRenamed("source", "cluster"), ["the", "of"]).select("cluster", "term", "n", r6(F.col("weight"), "weight"))


# --- aggregates ------------------------------------------------------------------------------------------------------------------


@query("""select 'doc_id' as "column", avg(case when doc_id is null then 1.0 else 0.0 end) null_proportion from documents union all select 'lang', avg(case when lang is
null then 1.0 else 0.0 end) from documents union all select 'text', avg(case when text is null then 1.0 else 0.0 end) from documents""")
def null_profile(t):
    return A.null_shares(t("documents", "doc_id", "lang", "text"))


@query("""with c as (select cast(year(o_orderdate) * 2 as int) y, count(*) n from orders group by 1) select cast(s.y as int) as year, coalesce(c.n, 0) n from (select
unnest(range((select min(y) from c), (select max(y) from c) + 1)) y) s left join c on s.y = c.y""")
def year_counts(t):
    return A.dense_counts(t("orders", "o_orderdate").select((F.year("o_orderdate") * 2).alias("year")), "year")  # twice the year, so that there are gaps


@query("""select trim(source) as value, count(*) n from documents where trim(source) <> '' group by 1""")
def category_counts(t):
    return A.value_counts(t("documents", "source"), F.col("source"))


@query("""with m as (select greatest(cast(ceil(max(l_quantity) / 10) as bigint) - 1, 0) b from lineitem) select least(cast(floor(l_quantity / 10) as bigint), b) bin,
count(*) n from lineitem, m group by 1""")
def quantity_histogram(t):
    return A.histogram(t("lineitem", "l_quantity"), F.col("l_quantity"))


@query("""select trim(v) as value, count(*) n from (select unnest(string_split(p_type, ' ')) v from part) where trim(v) <> '' group by 1 order by n desc, 1 limit 20""")
def exploded_counts(t):
    return A.exploded_top(t("part", "p_type"), F.col("p_type"), " ")


@query("""with x as (select quality = 1 t, n_chars >= 500 s from labels join documents using (doc_id)), c as (select count(*) filter (t and s) tp, count(*) filter (t and
not s) fn, count(*) filter (not t and s) fp, count(*) filter (not t and not s) tn, count(*) n from x)
select tp, fn, fp, tn, n, round(100.0 * (tp + tn) / n, 6) agreement, round(100.0 * (tp + fn) / n, 6) truth_rate, round(100.0 * (tp + fp) / n, 6) said_rate,
round(coalesce(100.0 * tp / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(100.0 * tp / nullif(tp + fn, 0), 0), 6) recall from c""")
def confusion_matrix(t):
    x = t("labels", "doc_id", "quality").join(t("documents", "doc_id", "n_chars"), "doc_id")
    c = A.confusion(x, F.col("quality") == 1, F.col("n_chars") >= 500)
    return c.select("tp", "fn", "fp", "tn", "n", *(r6(F.col(k), k) for k in ("agreement", "truth_rate", "said_rate", "precision", "recall")))


@query("""select lang, count(*) n, cast(sum(case when n_chars >= 500 then 1 else 0 end) as bigint) long, round(avg(case when n_chars >= 500 then 1.0 else 0.0 end), 6)
long_rate from documents group by rollup (lang)""")
def pass_rates(t):
    return A.pass_rates(t("documents", "lang", "n_chars"), "lang", long=F.col("n_chars") >= 500).select("lang", "n", "long", r6(F.col("long_rate"), "long_rate"))


@query("""select count(*) as "groups", round(avg(p), 6) mean_rate from (select source, avg(case when n_chars >= 500 then 100.0 else 0.0 end) p from documents group by
source)""")
def mean_pass_rate(t):
    return A.mean_of_rates(t("documents", "source", "n_chars"), "source", F.col("n_chars") >= 500).select("groups", r6(F.col("mean_rate"), "mean_rate"))


@query("""select round(avg(case when (value >= 50) = (event_type = 'purchase') then 1.0 else 0.0 end), 6) agreement, round(avg(case when value >= 50 and event_type <>
'purchase' then value end), 6) leaked_mean, round(avg(case when value >= 50 and event_type <> 'purchase' then value end) + 0.05, 6) suggested from events""")
def threshold_calibration(t):
    return A.threshold_report(t("events", "value", "event_type"), F.col("value"), F.col("event_type") == "purchase", 50.0).select(*(r6(F.col(c), c) for c in ("agreement", "leaked_mean", "suggested")))


@query("""select s_nationkey, count(*) n, count(*) filter (s_acctbal > 0) open, count(*) filter (s_acctbal > 5000) diamond, count(*) > 4 pass_any, count(*) filter
(s_acctbal > 5000) > 4 pass_diamond from supplier group by 1""")
def grouped_counts(t):
    return D.topic_counts(t("supplier", "s_nationkey", "s_acctbal"), "s_nationkey", F.col("s_acctbal") > 0, F.when(F.col("s_acctbal") > 5000, "diamond").otherwise("gold"), 4)


@query("""with c as (select s_nationkey, count(*) > 4 a, count(*) filter (s_acctbal > 5000) > 4 d from supplier group by 1) select n_regionkey, count(*) topics, count(*)
filter (a) pass_any, count(*) filter (d) pass_diamond from c join nation on s_nationkey = n_nationkey group by 1""")
def field_summary(t):
    return D.field_summary(grouped_counts(t).join(t("nation", "n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")), "n_regionkey")


@query("""with c as (select cast(l_linenumber as varchar) as value, count(*) n from lineitem group by 1) select value, n, cast(row_number() over (order by cast(value as
double)) as int) place from c""")
def value_distribution(t):
    return D.value_distribution(t("lineitem", "l_linenumber"), "l_linenumber")


@query(f"""with s as (select doc_id, left(text, 80) c, {SQL_SENTENCES} s from documents), f as (select c, [cast({sql_foreign('z')} as int) for z in s if length(trim(z))
>= 5] b from s),
p as (select coalesce(trim(c) <> '' and length(c) >= 5 and not {sql_foreign('c')}, false) t, coalesce(list_sum(b) / nullif(len(b), 0) < 0.2, false) a from f), n as
(select count(*) total, count(*) filter (t) title_pass, count(*) filter (a) abstract_pass, count(*) filter (t and a) both_pass from p)
select *, round(100.0 * title_pass / total, 6) title_pass_rate, round(100.0 * abstract_pass / total, 6) abstract_pass_rate, round(100.0 * both_pass / total, 6)
both_pass_rate from n""")
def language_diagnostics(t):
    x = F.col("text")
    d = D.language_diagnostics(t("documents", "text"), P.english_title(F.substring(x, 1, 80)), P.english_abstract(x, empty_passes=False))
    return d.select("total", "title_pass", "abstract_pass", "both_pass", *(r6(F.col(k), k) for k in ("title_pass_rate", "abstract_pass_rate", "both_pass_rate")))


@query(f"""with g as (select count(*) n from (select 1 from documents where text is not null group by lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) having count(*)
> 1)), p as ({SQL_SPOILED})
select count(*) scanned, count(*) filter (regexp_matches(lower(text), '({alternatives(T.NOISE_PATTERNS)})')) noisy, count(*) filter (lang = 'en' and
{sql_foreign('text')}) "foreign", count(*) filter (coalesce(trim(text) = '', true) or lang is null) missing,
count(*) filter (doc_id % 2 <> 0) unexpected_type, (select n from g) duplicate_groups from p""")
def corpus_diagnostics(t):
    x, d = F.col("text"), spoiled(t).join(t("documents", "doc_id", F.col("text").alias("own")), "doc_id")
    return D.corpus_diagnostics(d, F.col("own"), F.size(T.noise_found(x)) > 0, (F.col("lang") == "en") & T.suspicious_english(x), F.size(P.missing_fields(text=x, lang=F.col("lang"))) > 0, F.when(F.col("doc_id") % 2 == 0, "article").otherwise("dataset"))


@query("""with c as (select case when doc_id % 6 = 0 then 'h' when (doc_id % 6) / 10.0 < 0.35 then 's' else 'c' end k from documents), n as (select count(*) total,
count(*) filter (k = 'h') heuristic, count(*) filter (k = 's') semantic, count(*) filter (k <> 'c') garbage from c)
select *, round(100.0 * heuristic / total, 6) heuristic_rate, round(100.0 * semantic / total, 6) semantic_rate, round(100.0 * garbage / total, 6) garbage_rate from n""")
def scan_summary(t):
    k = F.col("doc_id") % 6
    d = t("documents", "doc_id").withColumns({"abstract": F.when(k == 0, F.when(F.col("doc_id") % 12 == 0, "").otherwise("see EasyBib")).otherwise("plain"), "similarity": k / 10.0})
    s = D.scan_summary(D.scanned(d, F.lit("title"), F.col("abstract"), F.col("similarity"), 0.35))
    return s.select("total", "heuristic", "semantic", "garbage", *(r6(F.col(c), c) for c in ("heuristic_rate", "semantic_rate", "garbage_rate")))


@query("""with c as (select c_mktsegment, c_acctbal > 0 pass, c_custkey from customer), r as (select c_mktsegment, count(*) n from c where not pass group by 1) select
c_custkey, c_mktsegment from (select *, row_number() over (order by c_custkey) r from c where not pass) where r <= 10""")
def failure_samples(t):
    return D.failures(t("customer", "c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_acctbal") > 0, "c_custkey").select("c_custkey", "c_mktsegment")


# --- topics ----------------------------------------------------------------------------------------------------------------------


def nations_as_topics(t):
    """Topics made of nations, with regions as fields; some lack names, ids or fields."""
    k = F.col("n_nationkey")
    field = F.when(k % 6 != 0, F.struct(F.concat(F.lit("https://x.org/fields/"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("display_name")))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("https://x.org/T"), k.cast("string"))).alias("id"), F.when(k % 4 != 0, F.col("n_name")).alias("display_name"), F.lit("d").alias("description"), (k * 1000).cast("bigint").alias("works_count"), field.alias("field"), F.lit(None).cast("struct<display_name: string>").alias("domain"))


SQL_TOPICS = """t as (select n_nationkey k, case when n_nationkey % 7 = 0 then ' ' else 'https://x.org/T' || n_nationkey end id, case when n_nationkey % 4 <> 0 then
n_name end name, n_nationkey * 1000 works, case when n_nationkey % 6 <> 0 then r_name end field, case when n_nationkey % 6 <> 0 then cast(r_regionkey as varchar) end
field_id
from nation join region on n_regionkey = r_regionkey)"""


@query(f"with {SQL_TOPICS} select field, array_to_string(list(id order by id), ',') ids from t where works >= 8000 and trim(id) <> '' and field is not null group by field")
def eligible_topics(t):
    return O.ids_by_field(O.eligible(nations_as_topics(t))).select("field", F.array_join("ids", ",").alias("ids"))


@query(f"with {SQL_TOPICS} select case when id = ' ' then ' ' else 'T' || k end topic_id, coalesce(name, 'Unknown') topic_name, coalesce(field_id, 'Unknown') field_id, coalesce(field, 'Unknown') field_name, 'Unknown' domain_name from t")
def flat_topics(t):
    return O.flat_topics(nations_as_topics(t))


@query(f"""with {SQL_TOPICS} select c_custkey, coalesce(name, case when c_nationkey % 7 <> 0 then 'T' || c_nationkey end, 'T' || c_nationkey) || ' (T' || c_nationkey ||
')' topic, coalesce(field || ' (' || field_id || ')', '') field
from customer left join t on c_nationkey = k and k % 7 <> 0""")
def topic_lookup(t):
    k = F.col("c_custkey") % 3
    bare = F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))
    url = F.when(k == 0, bare).when(k == 1, F.concat(F.lit("https://x.org/"), bare)).otherwise(F.concat(F.lit("https://x.org/"), bare, F.lit("//")))
    found = O.with_topics(t("customer", "c_custkey", "c_nationkey").withColumn("url", url), "url", nations_as_topics(t))
    return found.select("c_custkey", O.topic_label(F.col("topic.display_name"), bare).alias("topic"), O.field_label(F.col("topic.field.display_name"), F.col("topic.field.id")).alias("field"))


@query("""with l as (select s_suppkey, case when s_suppkey % 3 = 0 then 'High' else 'low' end confidence, s_nationkey from supplier) select s_suppkey, n_name from l left
join (select * from nation where n_nationkey < 12) on s_nationkey = n_nationkey where confidence = 'High'""")
def labels_with_metrics(t):
    labels = t("supplier", "s_suppkey", F.col("s_nationkey").alias("cluster")).withColumn("confidence", F.when(F.col("s_suppkey") % 3 == 0, "High").otherwise("low"))
    metrics = t("nation", F.col("n_nationkey").alias("cluster"), "n_name").filter("cluster < 12")
    return O.confident(O.with_metrics(labels, metrics)).select("s_suppkey", "n_name")


@query("""select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0""")
def verified_papers(t):
    o = t("orders", F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus")
    return O.verified(o.select("id").filter("id % 2 = 0"), o.select("id", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("pass"))).select(F.col("id").alias("o_orderkey"), "o_orderpriority")


@query("""select c_custkey, r_name field, case when c_custkey % 2 = 0 then n_name else c_name end topic from customer join nation on c_nationkey = n_nationkey join region
on n_regionkey = r_regionkey where n_nationkey < 20 and (c_custkey % 2 = 0 or c_custkey % 3 = 0)""")
def labelled_papers(t):
    k = F.col("c_custkey")
    papers = t("customer", "c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("n")).withColumn("folder", F.concat("n", F.lit("_"), (k % 2).cast("string"))).withColumn("topic_name", F.when(k % 3 == 0, F.col("c_name")).otherwise(""))
    n = t("nation").filter("n_nationkey < 20").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    labels = n.select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("odd"), "n_nationkey", "n_name", "r_name").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("_"), "odd").alias("folder"), F.col("r_name").alias("umbrella"), F.when(F.col("odd") == "0", F.col("n_name")).otherwise("").alias("label"))
    return O.labelled_papers(papers, labels).select("c_custkey", "field", "topic")


@query("""select s_suppkey from supplier order by s_acctbal desc, s_suppkey limit 1""")
def best_cluster(t):
    return O.best(t("supplier", "s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey")


@query("""select doc_id from documents order by md5(doc_id || ':42'), doc_id limit 15""")
def preview_sample(t):
    return O.preview(t("documents", "doc_id"), "doc_id")


@query("""select o_orderkey from (select o_orderkey, row_number() over (order by md5(o_orderkey || ':42'), o_orderkey) r, o_orderstatus from orders) where r <= 300 and
o_orderstatus = 'F'
and (select count(*) from (select o_orderstatus s, row_number() over (order by md5(o_orderkey || ':42'), o_orderkey) r from orders) where r <= 300 and s = 'F') < 100000""")
def topped_up_sample(t):
    return A.topped_up(t("orders", "o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "F", 300, chunk=300, rounds=1).select("o_orderkey")


@query("""select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' order by cast(o_orderkey as varchar) limit 40""")
def first_works(t):
    o = t("orders", F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", "o_orderpriority")
    return I.first_works(o, 40, o_orderstatus="O", o_orderpriority="1-URGENT").select(F.col("id").cast("bigint").alias("o_orderkey"))


@query("""select page_id, 'w' || page_id abstract from pages where page_id % 11 = 0""")
def point_lookup(t):
    p = t("pages", "page_id", "url").withColumns({"id": F.concat(F.lit("https://x.org/W"), F.col("page_id").cast("string")), "abstract_inverted_index": F.create_map(F.concat(F.lit("w"), F.col("page_id").cast("string")), F.array(F.lit(0)))})
    ids = t("pages", "page_id").filter("page_id % 11 = 0").select(F.concat(F.lit("W"), F.col("page_id").cast("string")).alias("id"))
    return I.wanted_works(p, ids).select("page_id", "abstract")


SQL_DELTAS = """x as (select case when o_orderstatus = 'O' then 'biased' else 'unbiased' end condition, o_custkey paper_id, o_orderpriority metadata, case when
o_totalprice > 150000 then 1 else 0 end selected from orders),
m as (select paper_id, metadata, avg(selected) filter (condition = 'biased') biased, avg(selected) filter (condition = 'unbiased') unbiased from x group by 1, 2), d as
(select *, biased - unbiased delta from m)"""


def _deltas(t):
    o = t("orders", "o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice")
    rows = o.select(F.when(F.col("o_orderstatus") == "O", "biased").otherwise("unbiased").alias("condition"), F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("metadata"), F.lit("t").alias("title"), (F.col("o_totalprice") > 150000).cast("int").alias("selected"))
    return A.deltas(rows)


@query(f"with {SQL_DELTAS} select paper_id, metadata, round(biased, 6) biased, round(unbiased, 6) unbiased, round(delta, 6) delta from d")
def selection_deltas(t):
    return _deltas(t).select("paper_id", "metadata", *(r6(F.col(c), c) for c in ("biased", "unbiased", "delta")))


@query("""with r as (select conv_id topic, list(text order by turn) c from conversations group by 1), p as (select conv_id topic, turn, text from conversations) select
p.topic, p.turn, cast(list_contains(r.c[1:2], p.text) as int) selected from p join r on p.topic = r.topic""")
def run_expansion(t):
    c = t("conversations", "conv_id", "turn", "text")
    runs = c.groupBy(F.col("conv_id").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("all")).select("topic", F.lit("u").alias("condition"), F.lit(0).alias("iteration"), F.slice("all", 1, 2).alias("citations"))
    papers = c.select(F.col("conv_id").alias("topic"), F.col("text").alias("paper_id"), F.col("turn").cast("string").alias("title"), F.lit("").alias("metadata"))
    return A.expanded(runs, papers).select("topic", F.col("title").cast("bigint").alias("turn"), "selected")


# --- statistics ------------------------------------------------------------------------------------------------------------------


#: p of a correlation in c (n, r), by Simpson's rule over the density of Student's t.
SQL_STUDENT = """t as (select n, r, n - 2 df, abs(r) * sqrt((n - 2) / (1 - r * r)) t from c),
s as (select n, r, df, sum((case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end) * exp(-(df + 1) / 2.0 * ln(1 + pow(t * k / 4000, 2) / df))) * t / 12000 s
from t, (select unnest(range(0, 4001)) k) group by n, r, df, t)
select n, round(r, 6) r, round(1 - 2 * s * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi() * df), 6) p from s"""


@query(f"""with c as (select count(*) n, corr(l_quantity, l_discount) r from lineitem), {SQL_STUDENT}""")
def pearson(t):
    return S.pearson(t("lineitem", "l_quantity", "l_discount"), "l_quantity", "l_discount").select("n", r6(F.col("r"), "r"), r6(F.col("p"), "p"))


@query(f"""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 a, rank() over (order by l_discount) + (count(*) over
(partition by l_discount) - 1) / 2.0 b from lineitem), c as (select count(*) n, corr(a, b) r from r), {SQL_STUDENT}""")
def spearman(t):
    return S.spearman(t("lineitem", "l_quantity", "l_discount"), "l_quantity", "l_discount").select("n", r6(F.col("r"), "r"), r6(F.col("p"), "p"))


@query("""with g as (select l_shipdate is not null, l_returnflag, count(*) n, avg(l_quantity) m, var_pop(l_quantity) v from lineitem group by all having count(*) > 1), t
as (select count(*) k, sum(n) n, sum(n * m) s, sum(n * m * m) q, sum(n * v) w from g),
f as (select k, n, ((q - s * s / n) / (k - 1)) / (w / (n - k)) f from t)
select k, cast(n as bigint) n, round(f, 5) f, round(pow((n - 3) / (n - 3 + 2 * f), (n - 3) / 2.0), 6) p from f""")
def anova(t):
    return S.anova(t("lineitem", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity").select("k", "n", F.round("f", 5).alias("f"), r6(F.col("p"), "p"))


@query("""with r as (select l_returnflag g, l_quantity x, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 a from lineitem), s as
(select g, count(*) n, sum(a) s from r group by g),
t as (select count(*) k, sum(n) n, sum(s * s / n) q from s), z as (select sum(c * c * c - c) t from (select cast(count(*) as double) c from lineitem group by
l_quantity)),
h as (select k, n, (12.0 / (cast(n as double) * (n + 1)) * q - 3.0 * (n + 1)) / (1 - z.t / (cast(n as double) * n * n - n)) h from t, z)
select k, cast(n as bigint) n, round(h, 5) h, round(exp(-h / 2), 6) p from h""")
def kruskal(t):
    return S.kruskal(t("lineitem", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity").select("k", "n", F.round("h", 5).alias("h"), r6(F.col("p"), "p"))


@query("""select round(regr_slope(l_extendedprice, l_quantity), 5) slope, round(regr_intercept(l_extendedprice, l_quantity), 3) intercept from lineitem""")
def trend_line(t):
    return S.trend(t("lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(f"with {SQL_DELTAS} select metadata, count(*) n, round(avg(delta), 6) mean from d where delta is not null group by 1")
def category_means(t):
    return D.category_means(_deltas(t), "metadata", "delta").select("metadata", "n", r6(F.col("mean"), "mean"))


@query(f"""with {SQL_DELTAS}, v as (select metadata g, delta x from d where delta is not null), g as (select g, count(*) n, avg(x) m, var_pop(x) v from v group by g), t
as (select count(*) k, sum(n) n, sum(n * m) s, sum(n * m * m) q, sum(n * v) w from g),
f as (select k, n, ((q - s * s / n) / (k - 1)) / (w / (n - k)) f from t), r as (select g, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 a from v),
u as (select count(*) k, sum(n) n, sum(s * s / n) q from (select g, count(*) n, sum(a) s from r group by g)),
z as (select sum(c * c * c - c) t from (select cast(count(*) as double) c from v group by x)), h as (select (12.0 / (cast(n as double) * (n + 1)) * q - 3.0 * (n + 1)) /
(1 - z.t / (cast(n as double) * n * n - n)) h from u, z)
select k, cast(n as bigint) n, round(f, 5) f, round(h, 5) h, round(pow((n - k) / (n - k + 4 * f), (n - k) / 2.0) * (1 + (n - k) / 2.0 * (1 - (n - k) / (n - k + 4 * f))),
6) p, round(exp(-h / 2) * (1 + h / 2), 6) p_h, 'categorical' kind from f, h""")
def effect_test(t):
    kind, found = S.effect(_deltas(t), "metadata", "delta")
    return found.select("k", "n", F.round("f", 5).alias("f"), F.round("h", 5).alias("h"), r6(F.col("p"), "p"), r6(F.col("p_h"), "p_h"), F.lit(kind).alias("kind"))


# --- order, samples, windows, sets -----------------------------------------------------------------------------------------------


@query("""select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 100""")
def top_by_score(t):
    return A.top_n(t("part", "p_partkey", "p_retailprice"), 100, F.desc("p_retailprice"), F.col("p_partkey"))


@query("""select p_partkey, p_brand from (select *, row_number() over (partition by lower(trim(p_brand)) order by p_retailprice desc, p_partkey) r from part) where r = 1""")
def best_of_name(t):
    return A.best_by_name(t("part", "p_partkey", "p_brand", "p_retailprice"), F.lower(F.trim("p_brand")), "p_retailprice", "p_partkey").select("p_partkey", "p_brand")


@query("""select s_suppkey from supplier order by case when s_acctbal > 9000 then 0 when s_acctbal > 0 then 1 else 2 end, s_acctbal desc, s_suppkey limit 1""")
def fallback_choice(t):
    b = F.col("s_acctbal")
    return A.fallback_choice(t("supplier", "s_suppkey", "s_acctbal"), "s_acctbal", b > 9000, b > 0).select("s_suppkey")


@query("""with x as (select l_suppkey g, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) r, l_quantity > 25 p from lineitem), y as (select *,
sum(cast(p as int)) over (partition by g order by r) s from x),
z as (select g, min(r) r from y where s >= 20 group by g) select d.g l_suppkey, cast(case when r <= 50 then 50 when 50 + 20 * ceil((r - 50) / 20.0) <= 230 then 50 + 20 *
ceil((r - 50) / 20.0) end as int) budget from (select distinct g from x) d left join z on d.g = z.g""")
def audit_budget(t):
    from pyspark.sql import Window as W

    x = t("lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").withColumn("r", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")))
    return A.budget_needed(x, "l_suppkey", "r", F.col("l_quantity") > 25)


@query("""select n_nationkey, run, cast((n_nationkey - run + 25) % 25 as int) place from nation, (select unnest(range(0, 5)) run)""")
def rotated_contexts(t):
    return A.rotated(t("nation", "n_nationkey").withColumn("rank", F.col("n_nationkey")), 5, 25).select("n_nationkey", F.col("run").cast("bigint").alias("run"), "place")


@query("""with r as (select doc_id, row_number() over (partition by source order by md5(doc_id || ':42'), doc_id) - 1 r, count(*) over (partition by source) n from
documents) select doc_id, cast(run as int) run, cast(((r - run) % n + n) % n as int) place from r, (select unnest(range(0, 3)) run)""")
def rotating_runs(t):
    return M.rotating_runs(t("documents", "doc_id", "source"), "source", "doc_id", 3).select("doc_id", "run", "place")


@query("""select doc_id, source from (select *, row_number() over (partition by source order by md5(doc_id || ':42'), doc_id) r from documents) where r <= 3""")
def stratified_sample(t):
    return A.stratified(t("documents", "doc_id", "source"), "source", "doc_id", 3)


@query("""select doc_id from documents order by md5(doc_id || ':42'), doc_id limit 50""")
def reservoir_sample(t):
    return A.reservoir(t("documents", "doc_id"), "doc_id", 50)


@query("""select l.doc_id from labels l where quality = 1 and l.doc_id not in (select doc_id from documents where lang = 'en')""")
def anti_join(t):
    return R.audited(t("labels").filter("quality = 1").withColumn("rank", F.lit(1)).withColumn("id", F.col("doc_id")), t("documents", "doc_id", "lang").filter("lang = 'en'").select(F.col("doc_id").alias("id")), 10).select("doc_id")


@query("""select d.doc_id, d.source, l.quality from documents d join labels l on d.doc_id = l.doc_id union all select doc_id, source, null from documents where doc_id not
in (select doc_id from labels)""")
def aligned_reports(t):
    d, l = t("documents", "doc_id", "source"), t("labels", "doc_id", "quality")
    return D.aligned(d, l, "doc_id").unionByName(d.join(l, "doc_id", "left_anti"), allowMissingColumns=True)


@query("""select c_custkey, coalesce(n_name, '') country from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20""")
def dimension_lookup(t):
    n = t("nation", "n_nationkey", "n_name").filter("n_nationkey < 20")
    return t("customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("country"))


# --- prompts and answers ---------------------------------------------------------------------------------------------------------


@query("""select conv_id, 'Read.' || chr(10) || chr(10) || 'role: who speaks' || chr(10) || chr(10) || string_agg('role: ' || role || chr(10) || 'text: ' || text, chr(10) || chr(10) order by turn) prompt
from conversations group by conv_id""")
def prompts(t):
    return R.prompt(t("conversations"), "conv_id", "turn", ["role", "text"], "Read.", {"role": "who speaks", "other": "not used"})


@query("""select conv_id, turn, case turn % 3 when 0 then [role, 'b'] else [] end citations, case turn % 3 when 0 then 'x' when 1 then 'no list' else 'y' end rest from
conversations""")
def citation_extraction(t):
    c = F.col("turn") % 3
    answer = F.when(c == 0, F.concat(F.lit('x ```json\n["'), F.col("role"), F.lit('", "b"]\n```'))).when(c == 1, "no list").otherwise('y ```json\n{"a": ```')
    x = t("conversations", "conv_id", "turn", "role").withColumn("a", answer)
    return x.select("conv_id", "turn", R.citations(F.col("a")).alias("citations"), R.without_fences(F.col("a")).alias("rest"))


@query("""select conv_id, turn, turn % 4 < 3 as "match", true eng, turn % 4 <> 1 as clean, turn % 4 in (0, 2) as "pass", case turn % 4 when 0 then 'ok' when 3 then
'[NLP Fallback] match: false, eng: true, clean: true oh...' else 'Parsed.' end explanation from conversations""")
def audit_verdicts(t):
    k = F.col("turn") % 4
    answer = F.when(k == 0, '{"match": true, "eng": true, "clean": true, "explanation": "ok"}').when(k == 1, 'see\n```json\n{"match": true, "eng": true, "clean": false}\n```').when(k == 2, 'well {"match": true, "eng": true, "clean": true} yes').otherwise('"match": false, "eng": true, "clean": true oh')
    return t("conversations", "conv_id", "turn").withColumn("v", R.verdict(answer)).select("conv_id", "turn", "v.match", "v.eng", "v.clean", "v.pass", "v.explanation")


@query("""select conv_id, turn, case when turn % 3 = 2 then '' else 'Name' end topic_name, case turn % 3 when 0 then 'high' when 1 then 'medium' else 'low' end confidence
from conversations""")
def topic_labelling(t):
    def model(prompts: list[str]) -> list[str]:
        fence = '```json_topic\n{"topic_name": "Name", "keywords": ["k"]%s}\n```'
        return [fence % ', "confidence": "high"' if p.startswith("0") else fence % "" if p.startswith("1") and "IMPORTANT" in p else "no fence" for p in prompts]

    c = t("conversations", "conv_id", "turn").withColumn("prompt", (F.col("turn") % 3).cast("string"))
    return R.labelled(c, "prompt", R.with_tries(model)).select("conv_id", "turn", "label.topic_name", "label.confidence")


@query("""select conv_id, turn, cast(length(text) as double) first, cast(1 as double) last from conversations""")
def text_embedding(t):
    return R.embedded(t("conversations", "conv_id", "turn", "text"), "text", lambda texts: [[float(len(x)), 1.0] for x in texts]).select("conv_id", "turn", F.col("vector")[0].alias("first"), F.col("vector")[1].alias("last"))


@query("""select conv_id, turn, cast(case turn % 4 when 0 then 77 when 1 then 10 when 2 then 50 else 0 end as int) score from conversations""")
def related_scores(t):
    k = F.col("turn") % 4
    answer = F.when(k == 0, 'a {"related_score": 77, "is_matching": true} b').when(k == 1, "a Redirect page").when(k == 2, "nothing").otherwise('{"is_matching": false}')
    return t("conversations", "conv_id", "turn").select("conv_id", "turn", R.related_score(answer).alias("score"))


@query("""select l.doc_id, l.doc_id % 2 = 0 as "pass" from (select doc_id, row_number() over (order by doc_id) r from labels) l where r <= 50 and doc_id not in (select
doc_id from documents where lang = 'fr')""")
def budgeted_audit(t):
    from pyspark.sql import Window as W

    def model(prompts: list[str]) -> list[str]:
        return ['{"match": %s, "eng": true, "clean": true}' % ("true" if p == "0" else "false") for p in prompts]

    papers = t("labels", "doc_id").withColumns({"id": F.col("doc_id"), "rank": F.row_number().over(W.orderBy("doc_id")), "prompt": (F.col("doc_id") % 2).cast("string")})
    log = t("documents", F.col("doc_id").alias("id"), "lang").filter("lang = 'fr'")
    return R.audit(papers, log, 50, "prompt", model).select("doc_id", "verdict.pass")
