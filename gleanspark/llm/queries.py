"""Queries of problems 1 to 5 and 7 to 9, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.llm import chunks, main_content, mixing, near_dups, packing, repeated_lines, residue, sentences
from gleanspark.session import table


#: Problem 1: words of a shingle, similarity and least number of words, as TESTDATA.md states them.
SCRAPE_COPIES = {"words": 3, "threshold": 0.6, "min_words": 80}


def p1_found(spark, sf_dir):
    return near_dups.group_pairs(near_dups.near_duplicates(table(spark, sf_dir, "scrapes"), **SCRAPE_COPIES))


def p1_groups(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "scrapes"), **SCRAPE_COPIES)


def p2_found(spark, sf_dir):
    return residue.residue(table(spark, sf_dir, "scrapes")).select("scrape_id")


def p3_found(spark, sf_dir):
    found = repeated_lines.repeated_lines(table(spark, sf_dir, "scrapes"))
    return found.where(found.line_docs >= repeated_lines.MIN_DOCS).select("scrape_id", "line_no")


def p3_cleaned(spark, sf_dir):
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "scrapes"))


def p3_clusters(spark, sf_dir):
    return repeated_lines.repeated_clusters(table(spark, sf_dir, "scrapes"))


def p3_near_cleaned(spark, sf_dir):
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "scrapes"), near=True)


def p4_found(spark, sf_dir):
    return main_content.main_lines(table(spark, sf_dir, "pages"))


def p4_text(spark, sf_dir):
    return main_content.main_content(table(spark, sf_dir, "pages"))


def p5_found(spark, sf_dir):
    return chunks.unit_starts(table(spark, sf_dir, "chunk_inputs"))


def p5_pieces(spark, sf_dir):
    return chunks.pieces(table(spark, sf_dir, "chunk_inputs"))


def p7_found(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))
    return packed.where("pieces > 1").select("capacity", "doc_id").distinct()


def p7_packed(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_totals(spark, sf_dir):
    """Per capacity what was placed, and how many containers hold more than they may."""
    packed = packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))
    bins = packed.groupBy("capacity", "container_no").agg(F.sum("size").alias("filled"), F.count("*").alias("pieces"))
    return bins.groupBy("capacity").agg(F.sum("filled").alias("tokens"), F.sum("pieces").alias("pieces"), F.count_if(F.col("filled") > F.col("capacity")).alias("overfull"))


def p7_waste(spark, sf_dir):
    """Containers used, against the least that could hold all, and the share of room left."""
    packed = packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))
    used = packed.groupBy("capacity").agg(F.countDistinct("container_no").alias("containers"), F.sum("size").alias("tokens"))
    return used.select("capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("waste"))


def p8_found(spark, sf_dir):
    mixer = mixing.Mixer(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixer.report().where("not reachable").select("mix_id", "source")


def p8_report(spark, sf_dir):
    return mixing.Mixer(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()


def p8_chosen(spark, sf_dir):
    return mixing.Mixer(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).chosen()


def p9_found(spark, sf_dir):
    return sentences.sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_pos")


def p9_sentences(spark, sf_dir):
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text, "p7_found": p7_found, "p7_packed": p7_packed, "p7_totals": p7_totals, "p7_waste": p7_waste, "p8_found": p8_found, "p8_report": p8_report, "p8_chosen": p8_chosen, "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p9_found": p9_found, "p9_sentences": p9_sentences, "p3_found": p3_found, "p3_cleaned": p3_cleaned, "p3_clusters": p3_clusters, "p3_near_cleaned": p3_near_cleaned, "p5_found": p5_found, "p5_pieces": p5_pieces}

_WS = "[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}\\x{200B}\\x{FEFF}]+"
SQL = {
    "p7_totals": "SELECT capacity, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(strlen(coalesce(text, '')) / capacity::DOUBLE))) AS BIGINT) AS pieces, CAST(0 AS BIGINT) AS overfull FROM documents, containers GROUP BY capacity",
    "p7_found": "SELECT DISTINCT capacity, doc_id FROM documents, containers WHERE strlen(text) > capacity",
    "p8_found": """
WITH t AS (SELECT mix_id, lower(trim(source)) AS source, sum(target_share) AS share, max(max_repeats) AS reps FROM mix_targets WHERE target_share IS NOT NULL GROUP BY ALL),
n AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS tokens FROM documents GROUP BY ALL),
j AS (SELECT t.*, coalesce(tokens, 0) AS tokens FROM t LEFT JOIN n USING (source)),
m AS (SELECT mix_id, sum(share) AS total, sum(tokens) AS size FROM j GROUP BY ALL)
SELECT mix_id, source FROM j JOIN m USING (mix_id) WHERE share / total * size > reps * tokens""",
    "p3_found": rf"""
WITH s AS (SELECT DISTINCT scrape_id, nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', ''), '') AS site, content FROM scrapes),
l AS (SELECT scrape_id, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM s WHERE site IS NOT NULL AND content IS NOT NULL AND scrape_id IS NOT NULL),
k AS (SELECT scrape_id, site, line_no, regexp_replace(trim(regexp_replace(lower(line), '{_WS}', ' ', 'g')), '[0-9]+', '0', 'g') AS k FROM l WHERE regexp_matches(line, '\p{{L}}')),
c AS (SELECT site, k FROM k GROUP BY site, k HAVING count(DISTINCT scrape_id) >= 10)
SELECT scrape_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN c USING (site, k)""",
}
