"""All queries of the byte-archive operators and their SQL."""

from bytestrata.plans import analysis_queries, catalog_queries, codec_queries, media_queries, profile_queries, window_queries
from bytestrata.session import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


PARTS = (catalog_queries, profile_queries, window_queries, codec_queries, media_queries, analysis_queries)
QUERIES = {k: _shipped(v) for part in PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in PARTS for k, v in part.SQL.items()}
