"""Language tables and scored language detection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, WORD_CLASS

# Reserved words and important constructs of the two languages.
DART_KEYWORDS = (
    'abstract', 'as', 'assert', 'async', 'await', 'break', 'case', 'catch',
    'class', 'const', 'continue', 'covariant', 'default', 'deferred', 'do',
    'dynamic', 'else', 'enum', 'export', 'extends', 'extension', 'external',
    'factory', 'false', 'final', 'finally', 'for', 'Function', 'get', 'hide',
    'if', 'implements', 'import', 'in', 'interface', 'is', 'late', 'library',
    'mixin', 'new', 'null', 'on', 'operator', 'part', 'required', 'rethrow',
    'return', 'set', 'show', 'static', 'super', 'switch', 'sync', 'this',
    'throw', 'true', 'try', 'typedef', 'var', 'void', 'while', 'with', 'yield',
)
SWIFT_KEYWORDS = (
    'associatedtype', 'class', 'deinit', 'enum', 'extension', 'fileprivate',
    'func', 'import', 'init', 'inout', 'internal', 'let', 'open', 'operator',
    'private', 'protocol', 'public', 'rethrows', 'static', 'struct', 'subscript',
    'typealias', 'var', 'break', 'case', 'continue', 'default', 'defer', 'do',
    'else', 'fallthrough', 'for', 'guard', 'if', 'in', 'repeat', 'return',
    'switch', 'where', 'while', 'as', 'Any', 'catch', 'false', 'is', 'nil',
    'super', 'self', 'Self', 'throw', 'throws', 'true', 'try', '_',
    '#available', '#colorLiteral', '#column', '#else', '#elseif', '#endif',
    '#error', '#file', '#fileLiteral', '#function', '#if', '#imageLiteral',
    '#line', '#selector', '#sourceLocation', '#warning', 'associativity',
    'convenience', 'dynamic', 'didSet', 'final', 'get', 'infix', 'indirect',
    'lazy', 'left', 'mutating', 'none', 'nonmutating', 'optional', 'override',
    'postfix', 'precedence', 'prefix', 'Protocol', 'required', 'right', 'set',
    'Type', 'unowned', 'weak', 'willSet', 'async', 'await', 'actor',
)
KEYWORDS = {"dart": DART_KEYWORDS, "swift": SWIFT_KEYWORDS}
KEYWORD_WEIGHT = 5.0

# Patterns that speak for a language, strong (2 points) and moderate (1 point).
DART_STRONG = (
    r'\bWidget\b', r'\bStatelessWidget\b', r'\bStatefulWidget\b',
    r'\bBuildContext\b', r'\bScaffold\b', r'\bFlutter\b',
    r'@override\s+Widget\s+build', r'pubspec\.yaml',
    r'\bmain\(\)\s*async\s*\{', r'\bFuture<\w+>',
    r'\bawait\s+\w+\.then\b', r'\bStreamController\b',
)
DART_MODERATE = (
    r'\bvoid\s+main\(\)', r'\bvar\s+\w+\s*=', r'\bfinal\s+\w+\s*=',
    r'\bconst\s+\w+\s*=', r'\bclass\s+\w+\s+extends\s+',
    r'print\([\'"].*[\'"]\)', r'\blate\s+\w+', r'\bdynamic\s+\w+',
    r'=>\s*\{', r'\$\{?\w+\}?',
)
SWIFT_STRONG = (
    r'\bfunc\s+\w+\([^)]*\)\s*->\s*\w+', r'\bvar\s+\w+:\s*\w+',
    r'\blet\s+\w+:\s*\w+', r'@IBOutlet', r'@IBAction',
    r'@Published', r'@State', r'@ObservedObject', r'@EnvironmentObject',
    r'\bimport\s+UIKit\b', r'\bimport\s+SwiftUI\b', r'\bimport\s+Foundation\b',
    r'\bstruct\s+\w+\s*:\s*View\b', r'\.swift\b', r'\bself\.\w+',
    r'init\([^)]*\)\s*\{',
)
SWIFT_MODERATE = (
    r'\bfunc\s+\w+\(', r'\bvar\s+\w+\s*=', r'\blet\s+\w+\s*=',
    r'\bclass\s+\w+\s*:\s*\w+', r'\bstruct\s+\w+\s*\{',
    r'\benum\s+\w+\s*\{', r'\bprotocol\s+\w+\s*\{',
    r'\bguard\s+let\b', r'\bif\s+let\b', r'\\\\\([^)]+\)',
    r'\bswitch\s+\w+\s*\{',
)
FRAMEWORK_POINTS = 3


def keywords(language: str) -> tuple[str, ...]:
    if language.lower() not in KEYWORDS:
        raise ValueError(f"no keywords for {language!r}: dart and swift are known")
    return KEYWORDS[language.lower()]


def unicode_pattern(pattern: str) -> str:
    """pattern with \\w and \\s as classes over all scripts, and a \\b at its ends as the character beside it, if there is one.

    For a search, whether such a character is taken or only looked at makes no difference.
    """
    out = pattern.removeprefix(r"\b").removesuffix(r"\b")
    if pattern.startswith(r"\b"):
        out = f"(?:^|[^{WORD_CLASS}])" + out
    if pattern.endswith(r"\b"):
        out += f"(?:$|[^{WORD_CLASS}])"
    return out.replace(r"\w", f"[{WORD_CLASS}]").replace(r"\s", f"[{SPACE_CLASS}]")


def search_pattern(pattern: str) -> str:
    """unicode_pattern() for a search that starts at the pattern's first word: what stands before it is looked at behind it."""
    word = re.match(r"\\b([A-Za-z]+)", pattern)
    if not word:
        return unicode_pattern(pattern)
    return f"{word[1]}(?<![{WORD_CLASS}]{word[1]})" + unicode_pattern("(?:)" + pattern[word.end() :])


def literal_of(pattern: str) -> str:
    """The longest text that every match of pattern holds."""
    fixed = re.split(r"\\[bws][*+]?|\[\^?[^\]]+\][*+]?|\.\*|\\?.\?", pattern)
    return max((re.sub(r"\\(.)", r"\1", x) for x in fixed), key=len)


def _points(code: Column, lower: Column, strong: tuple[str, ...], moderate: tuple[str, ...], frameworks: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for weight, patterns in ((2, strong), (1, moderate)):
        for p in patterns:
            # a plain search for the pattern's text spares most codes the pattern
            total = total + F.when(F.contains(code, F.lit(literal_of(p))) & code.rlike("(?dm)" + search_pattern(p)), weight).otherwise(0)
    named = F.lit(False)
    for f in frameworks:
        named = named | F.contains(lower, F.lit(f))
    return total + F.when(named, FRAMEWORK_POINTS).otherwise(0)


def language_points(code: Column) -> Column:
    """Struct (dart, swift) of points; each pattern counts once."""
    text = F.coalesce(code, F.lit(""))
    lower = F.lower(text)
    return F.struct(
        _points(text, lower, DART_STRONG, DART_MODERATE, ("flutter",)).cast("long").alias("dart"),
        _points(text, lower, SWIFT_STRONG, SWIFT_MODERATE, ("uikit", "swiftui")).cast("long").alias("swift"),
    )


def detect_language(points: Column) -> Column:
    """The language with more points; null on a tie, which only a parser can decide (operators.scores.detected_language)."""
    return F.when(points["dart"] > points["swift"], "dart").when(points["swift"] > points["dart"], "swift")
