"""All registered queries of this subpackage."""

from . import contamination, context_tree, html_text, licences, merkle, mixing, near_dups, privacy, quality, sharding, token_files, topk, vector_codes  # noqa: F401
from .catalog import ORACLE, QUERIES  # noqa: F401
