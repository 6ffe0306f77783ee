"""All registered queries of this subpackage."""

from flowtally.llm import ann, bpe, centroids, chat, filter_audit, jaccard, langid, mixing, quality_rules, repeats, secrets, simhash, warc
from flowtally.llm.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ann", "bpe", "centroids", "chat", "filter_audit", "jaccard", "langid", "mixing", "quality_rules", "repeats", "secrets", "simhash", "warc"]
