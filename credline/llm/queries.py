"""All queries of this subpackage; importing the modules registers them."""

from credline.llm import convtrie, decontaminate, language, neardup, ngramjoin, packing, pii, ranked, secrets, suffixdedup, topk, toxicity, warc  # noqa: F401
from credline.llm.common import ORACLE, QUERIES  # noqa: F401
