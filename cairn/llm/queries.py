"""The numbered queries and the SQL that states their results."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_middle, langid, license_scan, line_dedup, mixing, ngram_join, pii, secret_scan, sharding, url_filter, vector_codes

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_langid": langid.op5_langid,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE_SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_sharding": sharding.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op9_url_filter": url_filter.SQL,
    "op10_license_scan": license_scan.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
