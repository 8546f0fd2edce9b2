"""All queries of this subpackage; importing registers them."""

from lorescope.llm import language, lm, manifest, media, mixing, neardup, pieces, quality, secrets, sharding, tokenfiles, trie, winnowing  # noqa: F401
from lorescope.llm.registry import ORACLES, QUERIES  # noqa: F401
