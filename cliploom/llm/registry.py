"""The queries of this subpackage, by name, and SQL for those it can express."""

from __future__ import annotations

from functools import wraps

from .bagminhash import OP10_SQL, op10_near_duplicates
from .bpe import op4_byte_bpe
from .codebooks import op11_vector_codes
from .common import bounded_batches
from .decontaminate import OP9_SQL, op9_decontaminate
from .digest_sql import OP3_SQL, OP13_SQL
from .kdclusters import op12_centroid_clusters
from .language import op2_language
from .media import op3_media
from .secrets import OP7_SQL, op7_secrets
from .simhash import op13_simhash
from .suffixdedup import OP6_SQL, op6_suffix_dedup
from .tokencounts import op8_token_counts
from .toxicity import op1_toxicity
from .urlfilter import OP5_SQL, op5_url_filter
from .vector_sql import OP11_SQL, OP12_SQL


def _bounded(query):
    @wraps(query)
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_media": op3_media,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secrets": op7_secrets,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_simhash": op13_simhash,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}

ORACLES: dict[str, str] = {
    "op3_media": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_secrets": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_simhash": OP13_SQL,
}
