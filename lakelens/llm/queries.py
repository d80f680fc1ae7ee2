"""The queries of this subpackage: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import docpairs, packing, provenance, qa_defects, secrets, sentences, splitting, syntax, tokens


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _split(spark, d):
    return table(spark, d, "symbols"), table(spark, d, "retrieved_sources"), table(spark, d, "size_limits")


def p1_found(spark, d):
    return splitting.split_items(*_split(spark, d))


def p1_pieces(spark, d):
    return splitting.pieces(*_split(spark, d))


def p1_whole(spark, d):
    return splitting.whole_items(*_split(spark, d))


def p2_found(spark, d):
    return syntax.broken_files(table(spark, d, "source_files"))


def p2_errors(spark, d):
    return syntax.syntax_errors(table(spark, d, "source_files"))


def p2_rates(spark, d):
    return syntax.error_rates(table(spark, d, "source_files"))


def p3_found(spark, d):
    return docpairs.documented_keys(table(spark, d, "source_files"))


def p3_pairs(spark, d):
    return docpairs.documented_functions(table(spark, d, "source_files"))


def _texts(spark, d):
    return table(spark, d, "source_files"), table(spark, d, "finding_matches")


def p4_found(spark, d):
    return secrets.credential_lines(*_texts(spark, d))


def p4_credentials(spark, d):
    return secrets.credentials(*_texts(spark, d))


def p4_redacted(spark, d):
    return secrets.redacted(*_texts(spark, d))


def p5_found(spark, d):
    return provenance.unwritten_files(table(spark, d, "source_files"))


def p5_judged(spark, d):
    return provenance.judged(table(spark, d, "source_files"))


def p6_found(spark, d):
    return qa_defects.defects(table(spark, d, "qa_results"))


def p7_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


def p7_round_trip(spark, d):
    return tokens.round_trip(table(spark, d, "documents"))


def container_capacity(spark, d) -> int:
    """The capacity stands in a table of fixed size."""
    got = table(spark, d, "size_limits").where("item_kind = 'container'").agg(F.min("max_size")).first()[0]
    return int(got) if got else 2048


def p8_containers(spark, d):
    return packing.containers(table(spark, d, "documents"), container_capacity(spark, d))


def p8_placed(spark, d):
    return packing.placed(table(spark, d, "documents"), container_capacity(spark, d))


def p9_found(spark, d):
    return sentences.sentence_places(table(spark, d, "documents"))


def p9_sentences(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


def p9_covered(spark, d):
    return sentences.covered(table(spark, d, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql():
    return {
        "p1_whole": """
            SELECT 'symbol' AS item_kind, symbol_id AS item_id, 0 AS first_pos, length(body) AS last_pos, true AS is_whole FROM symbols
            WHERE length(body) > (SELECT max_size FROM size_limits WHERE item_kind = 'symbol_body')
            UNION ALL
            SELECT 'source', source_row_id, 0, length(content), true FROM retrieved_sources
            WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_kind = 'retrieved_source')""",
        "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p8_placed": "SELECT doc_id, true AS is_within FROM documents WHERE coalesce(text, '') <> ''",
        "p9_covered": f"SELECT * FROM (SELECT doc_id, length(regexp_replace(text, '{sentences.BLANKS}', '', 'g')) AS visible, true AS is_apart FROM documents) WHERE visible > 0",
        "p1_found": """
            SELECT 'symbol' AS item_kind, symbol_id AS item_id FROM symbols
            WHERE length(body) > (SELECT max_size FROM size_limits WHERE item_kind = 'symbol_body')
            UNION
            SELECT 'source' AS item_kind, source_row_id AS item_id FROM retrieved_sources
            WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_kind = 'retrieved_source')""",
    }
