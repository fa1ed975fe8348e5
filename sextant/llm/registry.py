"""Queries of this subpackage and their SQL."""

from . import bpe, decontaminate, delivery, filter_audit, kneser_ney, line_dedup, main_text, nearest, ngram_join, quality, repeats, unigram, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_quality": quality.op2,
    "op3_nearest": nearest.op3,
    "op4_token_counts": unigram.op4,
    "op5_kneser_ney": kneser_ney.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_repeats": repeats.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_warc": warc.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_main_text": main_text.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_delivery": delivery.op13,
}
ORACLE_SQL = {"op1_ngram_join": ngram_join.OP1_SQL, "op10_line_dedup": line_dedup.OP10_SQL, "op11_main_text": main_text.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_delivery": delivery.OP13_SQL, "op3_nearest": nearest.OP3_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op9_warc": warc.OP9_SQL}
