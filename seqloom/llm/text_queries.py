"""Queries of problems 7 (test passages in articles), 8 (mixing sources) and 9 (sentences)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .contamination import find_passages
from .mixing import margin_report, mix_sources, share_report
from .sentences import split_sentences


def _passages(spark: SparkSession, sf_dir: str, edits: bool) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"), edits)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned hits with the score that a verbatim window has at least, checked for such a window."""
    return _passages(spark, sf_dir, False).where("score >= 2 * window and run >= window").select("item_id", "doc_id").distinct()


def p7_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per article: the items that leaked into it verbatim or edited (similarity 0.8 or more), and the best of each kind."""
    f = _passages(spark, sf_dir, True).where("run >= window or similarity >= 0.8")
    return f.groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"), F.max("run").alias("longest_run"), F.round(F.max("similarity"), 6).alias("best_similarity"))


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of edited copies: every item of at least 30 words (60 characters in zh and ja) is put into a text of its own with every twelfth word (character) replaced; whether the item is found in it by similarity."""
    items = table(spark, sf_dir, "eval_items").where("passage is not null")
    blank = F.when(F.col("lang").isin("zh", "ja"), "").otherwise(" ")
    units = F.split("passage", blank)
    items = items.where(F.size(units) >= F.when(F.col("lang").isin("zh", "ja"), 60).otherwise(30)).select("item_id", "lang", "passage", units.alias("u"), blank.alias("blank"))
    edited = F.expr("array_join(transform(u, (x, i) -> CASE WHEN i % 12 < 11 THEN x WHEN blank = '' THEN '\u9f98' ELSE 'zzq' END), blank)")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.repeat(F.lit("qqa "), 30), edited, F.repeat(F.lit(" qqb"), 30)).alias("text"))
    hits = find_passages(docs, items.select("item_id", "lang", "passage")).where("similarity >= 0.8 and item_id = doc_id").select("item_id").distinct().withColumn("hit", F.lit(True))
    return items.select("item_id").distinct().join(hits, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("found"))


#: Folder of the public tokenizers' vocabularies, on every executor.
VOCABULARIES = "/opt/tokenizers"


def p8_mixture(spark: SparkSession, sf_dir: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "mixture_targets"), vocabulary)


def p8_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of every source, language and topic: available, fitted and reached."""
    return margin_report(p8_mixture(spark, sf_dir))


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: its documents, and whether its share is within 0.02 of the target, no document is used beyond the cap, and languages and topics come within 0.02 of what raking reached."""
    m = p8_mixture(spark, sf_dir)
    worst = margin_report(m).agg(F.max(F.abs(F.col("actual_share") - F.col("fitted_share"))).alias("worst"))  # one row
    return share_report(m, table(spark, sf_dir, "mixture_targets")).crossJoin(worst).select(
        "source", F.coalesce("documents", F.lit(0)).alias("documents"), (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.02).alias("share_met"),
        (F.coalesce("most_repeats", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"), (F.col("worst") <= 0.02).alias("margins_kept"),
    )


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mixture_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "sent_start", "sent_end")


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the spans of any article: articles with a text, and how many sentences are empty, begin or end with a blank, reach beyond the text or into the one before."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    s = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", "sent_end"))).alias("s"))  # bounded by one text
    j = docs.join(s, "doc_id", "left").withColumn("s", F.coalesce("s", F.expr("array()")))
    bad = lambda test: F.coalesce(F.sum(F.expr(f"size(filter(s, (x, i) -> {test}))")), F.lit(0)).cast("bigint")
    blank = lambda at: f"substr(text, int({at}), 1) rlike '^\\\\s$'"
    return j.agg(
        F.count(F.lit(1)).alias("articles"), bad("x.sent_end <= x.sent_start").alias("empty"), bad(blank("x.sent_start + 1") + " or " + blank("x.sent_end")).alias("blank_ends"),
        bad("x.sent_start < 0 or x.sent_end > length(text)").alias("outside"), bad("i > 0 and x.sent_start < s[i - 1].sent_end").alias("overlapping"),
    )


def p9_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the labelled texts below, in order."""
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELLED)], "doc_id bigint, text string")
    s = split_sentences(texts, "doc_id", "text").join(texts, "doc_id")
    return s.select("doc_id", "sent_start", F.expr("substr(text, int(sent_start) + 1, int(sent_end - sent_start))").alias("sentence"))


def p9_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per article: its sentences, their characters and the longest."""
    n = F.col("sent_end") - F.col("sent_start")
    return p9_found(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(n).alias("characters"), F.max(n).alias("longest"))


QUERIES = {
    "p7_found": p7_found, "p7_leak_report": p7_leak_report, "p7_edited": p7_edited, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_margins": p8_margins, "p8_bounds": p8_bounds,
    "p9_found": p9_found, "p9_invariants": p9_invariants, "p9_labelled": p9_labelled, "p9_sentence_stats": p9_sentence_stats,
}


# Labelled texts and their sentences.
LABELLED = [
    ("One two. Three four! Five?", ["One two.", "Three four!", "Five?"]),
    ("See Fig. 3 of Dr. Velm, e.g. here. P.-M. Orvel et al. agree.", ["See Fig. 3 of Dr. Velm, e.g. here.", "P.-M. Orvel et al. agree."]),
    ("Version v2.0.1 costs 8,042.0 or 3.8e-5. Done.Next one.", ["Version v2.0.1 costs 8,042.0 or 3.8e-5.", "Done.", "Next one."]),
    ("Wir kommen am 3. Mai an. Nr. 4 bleibt, z. B. hier, d.h. da.", ["Wir kommen am 3. Mai an.", "Nr. 4 bleibt, z. B. hier, d.h. da."]),
    ("A value $x_{9}=0.9$. That $f(x) < 54.86$ holds", ["A value $x_{9}=0.9$.", "That $f(x) < 54.86$ holds"]),
    ("``Is it so?\'\' asked the reader. ``It is.\'\' Then all left.", ["``Is it so?\'\' asked the reader.", "``It is.\'\'", "Then all left."]),
    ("All of it (a part [one. two.] stays here.) Then more. End", ["All of it (a part [one. two.] stays here.)", "Then more.", "End"]),
    ("He said \"go. Now.\" and left. So {\\em it is. Here} then.", ["He said \"go. Now.\" and left.", "So {\\em it is.", "Here} then."]),
    ("格问道：“信号保持？”这簇控制。下一句？最后", ["格问道：“信号保持？”这簇控制。", "下一句？", "最后"]),
    ("「近似し？」と述べ、定めた。次。", ["「近似し？」と述べ、定めた。", "次。"]),
    ("كل ليف، إلخ. هذا د. أورفيل مسار. هل؟ نعم", ["كل ليف، إلخ.", "هذا د. أورفيل مسار.", "هل؟", "نعم"]),
    ("वह डॉ. ओरवेल माप। कोई शेष? हर", ["वह डॉ. ओरवेल माप।", "कोई शेष?", "हर"]),
    ("กราฟลดเศษ วงจร v3.8.6 หยาบในปีพ.ศ. 2574 ขอบ ผิวใหม่", ["กราฟลดเศษ", "วงจร v3.8.6 หยาบในปีพ.ศ. 2574 ขอบ", "ผิวใหม่"]),
    ("Text one.\n\\begin{itemize}\n\\item First (a\n\\begin{enumerate}\n\\item Inner. More.\n\\end{enumerate}\n\\item Second.\n\\end{itemize}\nLast", ["Text one.", "First (a", "Inner.", "More.", "Second.", "Last"]),
]


def _labelled_rows() -> str:
    rows = []
    for i, (text, sentences) in enumerate(LABELLED):
        at = 0
        for x in sentences:
            at = text.index(x, at)
            rows.append("(%d, %d, '%s')" % (i, at, x.replace("'", "''")))
            at += len(x)
    return ", ".join(rows)


def _sql_plain(column: str) -> str:
    """SQL that reads a text as the operator does, for the accent commands on the letters that have composed forms."""
    x = f"regexp_replace({column}, '\\\\-', '', 'g')"
    for tex, mark in (("'", "́"), ("`", "̀"), ("^", "̂"), ('"', "̈"), ("~", "̃")):
        for letter in "aeiouyncAEIOUYNC":
            if len(c := unicodedata.normalize("NFC", letter + mark)) == 1:
                sign = ("\\" + tex if tex in "^" else tex).replace("'", "''")
                x = f"regexp_replace({x}, '\\\\{sign}\\s*(\\{{\\s*\\\\?{letter}\\s*\\}}|\\\\?{letter})', '{c}', 'g')"
    x = f"regexp_replace({x}, '\\\\(cite|ref|eqref|label)\\s*(\\[[^\\]]*\\])?\\{{[^{{}}]*\\}}', ' ', 'g')"
    return f"regexp_replace({x}, '\\\\[A-Za-z]+', ' ', 'g')"


SQL = {
    "p7_edited": """
        SELECT DISTINCT item_id, true AS found FROM eval_items
        WHERE CASE WHEN lang IN ('zh', 'ja') THEN length(passage) >= 60 ELSE len(string_split(passage, ' ')) >= 30 END""",
    "p9_invariants": """
        SELECT count(text) AS articles, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS blank_ends, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS overlapping FROM documents""",
    "p9_labelled": f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(sent_start AS BIGINT) AS sent_start, sentence FROM (VALUES {_labelled_rows()}) AS t(doc_id, sent_start, sentence)",
    "p8_bounds": """
        SELECT t.source, count(d.doc_id) AS documents, true AS share_met, true AS cap_kept, true AS margins_kept
        FROM mixture_targets t LEFT JOIN documents d ON replace(lower(trim(d.source)), '-', '_') = t.source GROUP BY t.source""",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, {_sql_plain('text')} AS t FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, lang IN ('zh', 'ja') AS han, {_sql_plain('passage')} AS t FROM eval_items WHERE passage IS NOT NULL),
        dw AS (SELECT doc_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM d),
        iw AS (SELECT item_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM i WHERE NOT coalesce(han, false)),
        dc AS (SELECT doc_id, regexp_replace(t, '[^\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS c FROM d),
        ic AS (SELECT item_id, regexp_replace(t, '[^\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS c FROM i WHERE han),
        dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM dw)
               UNION ALL SELECT doc_id, substr(c, k, 26) FROM (SELECT doc_id, c, unnest(range(1, length(c) - 24)) AS k FROM dc)),
        ig AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM iw)
               UNION ALL SELECT item_id, substr(c, k, 26) FROM (SELECT item_id, c, unnest(range(1, length(c) - 24)) AS k FROM ic))
        SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)""",
}
