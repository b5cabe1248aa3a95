"""One query for each operator of this package, over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mastline.llm import (
    chat,
    decontaminate,
    merkle,
    mixture,
    ngram_quality,
    phrases,
    pseudonyms,
    quality_rules,
    simhash,
    token_files,
    toxicity,
    url_rules,
    warc,
)
from mastline.llm.runtime import on_workers, table
from mastline.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return run(spark, sf_dir)

    query.__doc__ = run.__doc__
    QUERIES[run.__name__] = query
    return run


@_query
def op6_simhash_near_dedup(spark, sf_dir):
    """Groups of documents whose 3-word SimHash fingerprints differ in two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@_query
def op2_benchmark_decontamination(spark, sf_dir):
    """Each document's best window for every benchmark item of similarity 0.8 or more."""
    return decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file, at the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query
def op3_token_id_output(spark, sf_dir):
    """Token files of all documents in doc_id order, read back."""
    folder = new_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=0)
    return token_files.read(spark, folder)


@_query
def op1_quality_classifier(spark, sf_dir):
    """A quality score for every document, from rules learnt on the labels not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select(
        "doc_id",
        F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@_query
def op8_source_mixture(spark, sf_dir):
    """What a mix of all documents by source weights 5, 2, 1 takes of each."""
    return mixture.Mixture(table(spark, sf_dir, "documents")).documents()


@_query
def op7_quality_rules(spark, sf_dir):
    """Base counts of every document, and whether its n-grams look like the trusted ones."""
    docs = table(spark, sf_dir, "documents")
    target = ngram_quality.target_counts(docs, table(spark, sf_dir, "labels"))
    ratio = ngram_quality.weights(target, ngram_quality.counts(docs))
    return ngram_quality.judged(docs, ratio).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "llr",
    )


@_query
def op4_pii_pseudonyms(spark, sf_dir):
    """All documents with personal data replaced by pseudonyms of the same format."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, key="a key kept elsewhere")


@_query
def op10_url_filter(spark, sf_dir):
    """The verdict on every page's URL, by host rules and indexed patterns."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages).drop("url")


@_query
def op9_chat_formatting(spark, sf_dir):
    """All conversations and the probe, formatted with a loss mask and read back."""
    return chat.round_trip(chat.with_probe(table(spark, sf_dir, "conversations")))


@_query
def op5_warc_archive(spark, sf_dir):
    """All pages archived and read back."""
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.listed(spark, folder)


ORACLE["op5_warc_archive"] = """
SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN octet_length(payload) >= 100 AND page_id <> first_id THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN octet_length(payload) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS first_id
      FROM (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages))
"""


@_query
def op11_merkle_manifest(spark, sf_dir):
    """Merkle proofs of all documents; every second one was tampered with by losing its \\n."""
    tampered = F.expr(
        "CASE WHEN crc32(CAST(doc_id AS STRING)) % 2 = 0 THEN replace(text, '\\n', '') ELSE text END"
    )
    return merkle.checked_documents(table(spark, sf_dir, "documents"), tampered).drop("source")


def _sql_leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS code FROM documents, crc),
digests AS (SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
  CASE WHEN code % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS found FROM docs),
leaves AS (SELECT *, row_number() OVER () AS id, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
up AS (SELECT source, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
fold AS (SELECT id, source, 0 AS lvl, pos, found AS h, '' AS proof FROM leaves
  UNION ALL SELECT f.id, f.source, f.lvl + 1, f.pos // 3,
    sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.h ELSE u.h END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), '')
  FROM fold f JOIN up u ON u.source IS NOT DISTINCT FROM f.source AND u.lvl = f.lvl AND u.pos // 3 = f.pos // 3
  WHERE u.n > 1 GROUP BY f.id, f.source, f.lvl, f.pos, f.proof),
subroots AS (SELECT source, lvl, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
  count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM up2 WHERE n > 1 GROUP BY lvl, pos // 3, n),
fold2 AS (SELECT f.id, 0 AS lvl, s.pos, f.h, f.proof, s.subroot FROM fold f JOIN subroots s
    ON s.source IS NOT DISTINCT FROM f.source AND s.lvl = f.lvl
  UNION ALL SELECT f.id, f.lvl + 1, f.pos // 3,
    sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.h ELSE u.h END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), ''), f.subroot
  FROM fold2 f JOIN up2 u ON u.lvl = f.lvl AND u.pos // 3 = f.pos // 3
  WHERE u.n > 1 GROUP BY f.id, f.lvl, f.pos, f.proof, f.subroot)
SELECT l.doc_id, l.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN fold2 f USING (id) JOIN (SELECT lvl, h FROM up2 WHERE n = 1) r ON r.lvl = f.lvl
"""


@_query
def op12_toxicity(spark, sf_dir):
    """A toxicity score for every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        F.expr("coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false)").alias("held_out"),
        toxicity.score_column(spark, network, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query
def op13_phrase_collocations(spark, sf_dir):
    """Each language's 2,000 closest phrases of two or three words seen ten times."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_phrase_collocations"] = r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece,
    list_filter(string_split_regex(p, '[ \x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words
  WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, 1 AS len, w1 AS phrase, w1, NULL AS w2, NULL AS w3, count(*) AS f FROM runs GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
c AS (SELECT * FROM f WHERE len > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, len, f AS a, 1 AS k, w1 AS head, CASE len WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS tail FROM c
  UNION ALL SELECT lang, phrase, len, f, 2, w1 || ' ' || w2, w3 FROM c WHERE len = 3),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.len, a, l.f AS l, r.f AS r, k,
    (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM c WHERE len = 3
    UNION ALL SELECT lang, w2 || ' ' || w3, f FROM c WHERE len = 3) GROUP BY ALL),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
