"""The queries of this subpackage and their SQL."""

from . import backoff, centroids, chat, decontaminate, jaccard, language, pieces, quality, spelling, substrings, token_counts, urls, warc


def queries() -> dict:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_url_filter": urls.op3_url_filter,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_warc": warc.op5_warc,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_chat_format": chat.op8_chat_format,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_centroid_clustering": centroids.op12_centroid_clustering,
        "op13_lm_scoring": backoff.op13_lm_scoring,
    }


def oracle_sql() -> dict:
    return {
        "op2_jaccard_join": jaccard.SQL,
        "op3_url_filter": urls.SQL,
        "op4_quality_rules": quality.SQL,
        "op5_warc": warc.SQL,
        "op7_substring_dedup": substrings.SQL,
        "op9_decontaminate": decontaminate.SQL,
        "op11_spelling_variants": spelling.SQL,
        "op12_centroid_clustering": centroids.SQL,
    }
