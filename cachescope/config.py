"""Parameters that change results.

The defaults below are the gateway's documented constants; every operator takes
them as keyword arguments so a caller can override any of them.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values (must equal the gateway's defaults for identical results) ---
DISTANCE_THRESHOLD = 0.15          # cosine distance, inclusive: dist <= tau is a hit
EMBEDDING_DIM = 768
EMBEDDING_MODEL = "gemini-embedding-001"
TOKENS_PER_HIT = 1500
COST_PER_TOKEN = 0.000002          # about $2 per 1M tokens
EVENT_RING_SIZE = 100
EVENT_FEED_LIMIT = 50
TIMELINE_MINUTES = 30
BUCKET_TTL = "2 hours"             # minute buckets expire after this long
LATENCY_IDLE_GAP = "24 hours"      # latency sum/count expire after this idle time
SESSION_TTL_SECONDS = 7 * 24 * 3600
DEFAULT_CHAT_MODEL = "llama-3.3-70b-versatile"
CACHE_LIST_LIMIT = 50
RESPONSE_PREVIEW_CHARS = 120
HIT_PREVIEW_BYTES = 60
PII_PREVIEW_CHARS = 80
KEY_PREFIX = "prompt:"
ELLIPSIS = "…"
SESSION_ID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# --- end of fixed values ---


@dataclass(frozen=True)
class GatewayParams:
    """All result-changing configuration in one place (batch and streaming share it)."""

    threshold: float = DISTANCE_THRESHOLD
    dim: int = EMBEDDING_DIM
    model: str = EMBEDDING_MODEL
    tokens_per_hit: int = TOKENS_PER_HIT
    cost_per_token: float = COST_PER_TOKEN
    ring_size: int = EVENT_RING_SIZE
    feed_limit: int = EVENT_FEED_LIMIT
    timeline_minutes: int = TIMELINE_MINUTES
    latency_gap: str = LATENCY_IDLE_GAP
    session_ttl_seconds: int = SESSION_TTL_SECONDS
    list_limit: int = CACHE_LIST_LIMIT
    preview_chars: int = RESPONSE_PREVIEW_CHARS
