"""Thresholds, lexicons and profiles. Fixed values that results depend on stand here as plain text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Regexes and words that tell openings and endings; words match as substrings of the lower-cased text."""

    hook_patterns: tuple[str, ...]
    hook_words: tuple[str, ...]
    ending_patterns: tuple[str, ...]
    ending_words: tuple[str, ...]


# Fixed values.
ENGLISH = Lexicon(
    hook_patterns=(
        r"^(what|how|why|when|where|who)\s", r"^did you know", r"^have you ever", r"^imagine", r"^here's the thing", r"^let me tell you",
        r"^the secret is", r"^nobody talks about", r"^question:", r"^challenge:", r"^problem:", r"^you need to know", r"^listen to this",
    ),
    hook_words=("what", "how", "why", "imagine"),
    ending_patterns=(
        r"(so that's|therefore|in summary|that's why|the takeaway is)", r"(subscribe|follow|like this|comment below|share this)",
        r"(next time|see you|thanks for watching|until next time)",
    ),
    ending_words=("so", "therefore", "that is why", "in summary"),
)
#: Frequent openers and closers of the driver's invented prose, so that joins and folds carry volume.
INVENTED = Lexicon((r"^(the|of|and|in|to|le|la|de|die|der|el|en)\s",), (), (r"(the|of|and|in|la|de|die|der)\.$", r"(er|on)\.$"), ())
# Words without content, and pronouns.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "but", "it", "that", "this", "with", "as", "by",
    "from", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might", "shall", "should",
    "not", "no", "nor", "so", "if", "then", "than", "too", "very", "just", "about", "also", "more", "some", "any", "each", "every", "all", "both",
    "few", "most", "other", "into", "over", "such", "only", "own", "same",
)
PRONOUNS = ("he", "she", "it", "they", "him", "her", "his", "their")
CURIOSITY = ("secret", "truth", "why", "how", "never", "always", "actually")
HOOK_OBJECTIVE_WORDS = ("secret", "truth", "why", "how", "never", "always")
CLAIMS = ("secret", "truth", "fact", "proof", "reason", "why")
NEW_TOPIC = ("but", "however", "also", "another", "speaking of")
CALLS = ("subscribe", "follow", "like", "comment", "share")
SUMMARIES = ("so", "therefore", "that's", "basically")
STAGE_WEIGHTS = {"narrative": 0.25, "context": 0.20, "hook_quality": 0.15, "density": 0.15, "retention": 0.15, "novelty": 0.10}
CLIP_WEIGHTS = {"hook": 0.35, "body": 0.25, "ending": 0.20, "flow": 0.20}
PORTFOLIO_POLICIES = {"balanced": (0.7, 0.3), "quality": (0.85, 0.15), "diverse": (0.5, 0.5), "strict": (0.9, 0.1)}
#: Milliseconds by stage; other stages have DEFAULT_BUDGET_MS.
STAGE_BUDGETS = {
    "windows": 100, "signals": 200, "evidence": 500, "graph": 300, "roles": 150, "strategies": 1000,
    "dedup": 100, "objectives": 2000, "narrative": 200, "portfolio": 200, "evaluation": 50,
}
DEFAULT_BUDGET_MS = 1000
