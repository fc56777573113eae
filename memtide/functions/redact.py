"""Redaction of secrets by ordered patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"

#: Name and pattern, applied in this order. ``(?iu)`` is needed where case folds beyond ASCII.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("openai_style_key", r"\b(sk-[a-z0-9]{16,}|sk-proj-[a-z0-9_-]{16,}|sk-ant-[a-z0-9]{16,})\b"),
    ("api_key_assignment", r"(?iu)(?:api[_-]?key|apikey|secret[_-]?key|openai[_-]?key|anthropic[_-]?key)\s*[:=]\s*['\"]?([a-z0-9_\-]{16,})['\"]?"),
    ("github_token", r"\b(gh[pousr]_[A-Za-z0-9_]{36,}|github[_-]?pat[_-]?[A-Za-z0-9]{20,})\b"),
    ("aws_credentials", r"(?isu)\b(AKI[A-Z0-9]{16})\b.*?(?:secret[_-]?access[_-]?key\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})['\"]?|[A-Za-z0-9/+=]{40})"),
    ("jwt", r"\b(eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)\b"),
    ("authorization_header", r"(?iu)(authorization\s*:\s*(?:bearer|basic)\s+)[A-Za-z0-9_\-./+=]+"),
    ("password", r"(?iu)(?:password|passwd|pwd)\s*[:=]\s*['\"]?([^\s'\"]{4,})['\"]?"),
    ("url_credentials", r"(?iu)([a-z+]+://[^:/\s]+:)([^@\s]+)(@[^\s]+)"),
    ("env_secret_assignment", r"(?iu)([A-Z_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|PWD|APIKEY|API_KEY)[A-Z_]*\s*=\s*['\"]?)([A-Za-z0-9_\-./+=]{8,})['\"]?"),
)


def redact(text: Column, patterns: Sequence[str] | None = None, enabled: bool = True) -> Column:
    """Whole matches become a mark. ``None`` means the default patterns, an empty list none."""
    if enabled:
        for pattern in [p for _, p in PATTERNS] if patterns is None else patterns:
            text = F.regexp_replace(text, pattern, MARK)
    return text


def redact_messages(messages: Column, key: str = "content", patterns: Sequence[str] | None = None) -> Column:
    """An array of message structs with the field ``key`` redacted."""
    return F.transform(messages, lambda m: m.withField(key, redact(m[key], patterns)))
