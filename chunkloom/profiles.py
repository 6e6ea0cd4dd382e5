"""Project profiles: which files count, how they are cut, which words matter.

A profile is plain data. Users pass their own ``Profile`` (or ``dataclasses.replace`` a
built-in one) to every operator that takes one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------
# Fixed values shared by all profiles: word lists, tags and patterns that results depend on.
UI_ELEMENTS = [
    "Button", "TextView", "EditText", "TextField", "ListView", "RecyclerView",
    "Image", "Input", "Select", "Form", "Table", "Dropdown",
]
NAVIGATION_WORDS = ["navigate", "startactivity", "router.push", "href", "onclick"]
INDICATOR_WORDS = {
    "calculation": ["calc", "price", "total", "subtotal", "tax", "amount", "sum", "net", "fee", "value"],
    "validation_logic": ["validate", "setError", "isValid", "required", "error", "fail", "assert", "check"],
    "workflow": ["next", "step", "action", "proceed", "confirm", "back", "continue", "submit", "cancel", "approve"],
    "authorization": ["auth", "token", "permission", "granted", "allowed", "jwt", "session"],
}
# Indicator tag -> key of the business index.
BUSINESS_KEYS = {
    "calculation": "calculations",
    "validation_logic": "business_processes",
    "workflow": "workflows",
    "authorization": "authorization",
}
VALIDATION_PATTERNS = {
    "required_check": r'\.isEmpty\(|==\s*""',
    "email_format_check": r'\.contains\("@"\)',
    "regex_match": r"\.matches\([^)]+\)",
    "set_error_triggered": r"setError\(",
    "length_check": r"length\s*[<>=]{1,2}\s*\d+",
    "custom_validator": r"(?iU)\b(validate|check|assert)([A-Z][a-zA-Z]+)?\b",
}
# Possessive quantifiers only save backtracking here: words and white space never overlap.
FUNCTION_PATTERNS = {
    "py": [r"def\s+(\w+)"],
    "kt kts java": [r"fun\s+(\w+)", r"(?:public|private|protected|static)?\s*\w++\s++(\w++)\s*+\("],
    "js ts jsx tsx": [r"function\s+(\w+)", r"const\s+(\w+)\s*=", r"let\s+(\w+)\s*=", r"var\s+(\w+)\s*="],
}
CLASS_PATTERNS = {
    "py": [r"class\s+(\w+)"],
    "kt kts java js ts jsx tsx": [r"class\s+(\w+)", r"object\s+(\w+)", r"interface\s+(\w+)", r"enum\s+(\w+)"],
}
INPUT_PATTERNS = {
    "xml": [r'<(?:EditText|TextInputLayout|AutoCompleteTextView)[^>]*android:id="[^@]*@\+id/([\w_]+)'],
    "kt kts java": [r"TextField\s*\([^)]*value\s*=\s*(\w+)"],
    "tsx jsx html": [r"""[<(][^>]*\s(?:id|name)=["']([\w_]+)["']"""],
}
IMPORT_EXTENSIONS = ["py", "ts", "js", "kt", "kts", "java", "swift"]
NAME_PATTERNS = {
    "py": [r"class\s+(\w+)", r"def\s+(\w+)", r"async\s+def\s+(\w+)"],
    "js ts jsx tsx kt java": [r"class\s+(\w+)", r"function\s+(\w+)", r"fun\s+(\w+)", r"object\s+(\w+)"],
}
CLASS_SYMBOLS = [r"class\s+(\w+)", r"object\s+(\w+)", r"interface\s+(\w+)"]
FUNCTION_SYMBOLS = [r"def\s+(\w+)", r"fun\s+(\w+)", r"function\s+(\w+)"]
COMMENT_STARTS = ["#", "//", "/*", "*", "import"]
# (points, words, pattern) of the semantic score; each counts once per chunk. A match
# contains one of the words, so texts without them skip the regular expression.
SCORE_PATTERNS = [
    (2.0, ["class"], r"(?U)\bclass\s+\w+"),
    (1.5, ["fun", "def"], r"(?U)\bfun\s+\w+|\bdef\s+\w+"),
    (1.0, ["import", "from"], r"(?U)\bimport\s+|\bfrom\s+"),
    (1.0, ["config", "setup"], r"(?iU)\bconfig\b|\bsetup\b"),
    (1.5, ["Button", "TextView", "RecyclerView", "Fragment"],
     r"(?U)\bButton\b|\bTextView\b|\bRecyclerView\b|\bFragment\b"),
]
# The same for the one slow validation pattern.
CUSTOM_VALIDATOR_WORDS = ["validate", "check", "assert"]
SCORE_LENGTHS = [(0.5, 500), (0.5, 1000)]
ANCHORS = ["screen_name", "class_names", "function_names", "component_name"]
INDEX_LEVELS = {
    "overview": "file_level",
    "impact_analysis": "dependency_level",
    "business_logic": "business_level",
    "ui_flow": "ui_level",
    "technical": "component_level",
    "api": "api_level",
}
# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    name: str
    extensions: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    indicators: tuple[str, ...] = ()
    chunk_types: dict[str, list[str]] = field(default_factory=dict)
    screens: tuple[str, ...] = ()
    components: tuple[str, ...] = ()
    priority_words: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    # Everything below may be replaced by a custom profile.
    function_patterns: dict[str, list[str]] = field(default_factory=lambda: FUNCTION_PATTERNS)
    class_patterns: dict[str, list[str]] = field(default_factory=lambda: CLASS_PATTERNS)
    input_patterns: dict[str, list[str]] = field(default_factory=lambda: INPUT_PATTERNS)
    validation_patterns: dict[str, str] = field(default_factory=lambda: VALIDATION_PATTERNS)
    indicator_words: dict[str, list[str]] = field(default_factory=lambda: INDICATOR_WORDS)
    ui_elements: list[str] = field(default_factory=lambda: UI_ELEMENTS)
    navigation_words: list[str] = field(default_factory=lambda: NAVIGATION_WORDS)
    unicode_classes: bool = True    # \w and \s follow Unicode; off = ASCII only

    @property
    def flags(self) -> str:
        """Boundary flags: ``^`` after every newline, and only after newlines."""
        return "(?mdU)" if self.unicode_classes else "(?md)"

    def regex(self, pattern: str) -> str:
        """A search pattern with the profile's reading of ``\\w`` and ``\\s``."""
        has_flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
        return f"(?U){pattern}" if self.unicode_classes and not has_flags else pattern

    @property
    def boundaries(self) -> list[str]:
        return [p for patterns in self.chunk_types.values() for p in patterns if p.startswith("^")]


# The built-in profiles. Order matters for project detection.
_ANDROID = Profile(
    name="android",
    extensions=(".md", ".kt", ".kts", ".java", ".xml", ".gradle", ".properties", ".toml"),
    ignore=("build/", "*.apk", "*.dex", ".gradle/"),
    indicators=("AndroidManifest.xml", "app/build.gradle", "app/build.gradle.kts"),
    chunk_types={
        "class": [
            r"^\s*(?:public|private|protected|internal|open|sealed|data|abstract|final|enum|annotation)?\s*"
            r"(?:class|object|interface|enum|annotation)\s+\w+",
        ],
        "function": [
            r"^\s*(?:(?:suspend|internal|private|protected|public|operator|override|inline|external|static|final"
            r"|abstract|open)\s+)*fun\s+\w+",
            r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp)\s+)+"
            r"\w+\s+\w+\s*\(",
        ],
        "import": [r"^\s*import\s+[^\s]+", r"^\s*package\s+[^\s]+"],
        "annotation": [r"^\s*@\w+", r"^\s*annotation\s+\w+"],
    },
    screens=("([A-Z][a-zA-Z0-9]+Activity)", "([A-Z][a-zA-Z0-9]+Fragment)", "([A-Z][a-zA-Z0-9]+Screen)"),
    priority_words=("activity", "fragment", "manifest", "mainactivity", "service", "viewmodel"),
    keywords=("android", "activity", "fragment", "kotlin", "java"),
)
_IOS = Profile(
    name="ios",
    extensions=(".md", ".swift", ".m", ".h", ".plist", ".storyboard", ".xib"),
    ignore=("DerivedData/", "*.xcuserstate", "*.xcworkspace", "*.xcodeproj/"),
    indicators=("Info.plist", "AppDelegate.swift"),
    chunk_types={
        "class": [r"^\s*(?:public|private|internal|open|final)?\s*(?:class|struct|enum|protocol)\s+\w+"],
        "function": [
            r"^\s*(?:(?:mutating|static|class|private|public|internal|open|final|override)\s+)*func\s+\w+",
            r"^\s*- \([\w\s*]+\)\w+\s*\{",
        ],
        "import": [r"^\s*import\s+[^\s]+", r"^\s*@import\s+[^\s]+"],
    },
    screens=("([A-Z][a-zA-Z0-9]+ViewController)",),
    priority_words=("AppDelegate", "SceneDelegate", "ViewController"),
    keywords=("ios", "swift", "viewcontroller", "apple", "objective-c"),
)
_JAVA = Profile(
    name="java",
    extensions=(".md", ".java", ".xml", ".gradle", ".properties", ".toml", ".jar"),
    ignore=("build/", "out/", "*.class", "*.jar", ".gradle/"),
    indicators=("pom.xml", "build.gradle", "settings.gradle", "src/main/java"),
    chunk_types={
        "class": [
            r"^\s*(?:public|private|protected|abstract|final|static|sealed|non-sealed)?\s*"
            r"(?:class|interface|enum|record)\s+\w+",
        ],
        "function": [
            r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp)\s+)*"
            r"\w+\s+\w+\s*\(",
        ],
        "import": [r"^\s*import\s+[^\s]+", r"^\s*package\s+[^\s]+"],
        "annotation": [r"^\s*@\w+", r"^\s*annotation\s+\w+"],
    },
    screens=("([A-Z][a-zA-Z0-9]+Activity)", "([A-Z][a-zA-Z0-9]+Controller)", "([A-Z][a-zA-Z0-9]+Servlet)"),
    priority_words=("Main", "App", "Application", "Activity", "Controller", "Service", "Servlet"),
    keywords=("java", "spring", "servlet", "activity", "controller"),
)
_JAVASCRIPT = Profile(
    name="javascript",
    extensions=(".md", ".js", ".ts", ".jsx", ".tsx", ".json", ".mjs"),
    ignore=("node_modules/", "dist/", "build/", "*.min.js"),
    indicators=("package.json", "tsconfig.json"),
    chunk_types={
        "class": [r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+\w+"],
        "function": [
            r"^\s*(?:export\s+)?(?:async\s+)?function\s+\w+",
            r"^\s*(?:const|let|var)\s+\w+\s*=\s*\(?\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>",
            r"^\s*function\s+\w+",
        ],
        "import": [
            r"^\s*import\s+.*from\s+",
            r"""^\s*import\s+['"]?[^'"\\s]+['"]?""",
            r"^\s*require\([^)]+\)",
        ],
        "type": [r"^\s*type\s+\w+", r"^\s*interface\s+\w+"],
    },
    screens=("([A-Z][a-zA-Z0-9]+Page)", "([A-Z][a-zA-Z0-9]+Screen)", "([A-Z][a-zA-Z0-9]+Component)"),
    priority_words=("index", "app", "main", "server"),
    keywords=("javascript", "typescript", "react", "node", "express"),
)
_PYTHON = Profile(
    name="python",
    extensions=(".md", ".py", ".pyx", ".pyi", ".txt", ".yml", ".yaml"),
    ignore=("__pycache__/", "*.pyc", ".pytest_cache/", "venv/"),
    indicators=("requirements.txt", "setup.py", "pyproject.toml"),
    chunk_types={
        "class": [r"^\s*(?:@[\w\.]+\s*)*class\s+\w+"],
        "function": [r"^\s*(?:@[\w\.]+\s*)*(?:async\s+)?def\s+\w+"],
        "import": [r"^\s*import\s+[^\s]+", r"^\s*from\s+[^\s]+"],
        "decorator": [r"^\s*@[\w\.]+"],
    },
    priority_words=("main", "app", "__init__", "server", "manage"),
    keywords=("python", "django", "flask", "fastapi"),
)
_WEB = Profile(
    name="web",
    extensions=(".md", ".html", ".css", ".scss", ".sass", ".js", ".ts", ".vue", ".svelte"),
    ignore=("node_modules/", "dist/", "build/"),
    indicators=("index.html", "package.json"),
    chunk_types={
        "component": [r"^\s*(?:export\s+default\s+)?(?:component)?\s*(\w+)", r"^\s*component\s+(\w+)"],
        "function": [
            r"^\s*function\s+\w+", r"^\s*const\s+\w+\s*=\s*", r"^\s*let\s+\w+\s*=\s*", r"^\s*\w+\s*=>",
        ],
        "style": [r"^\s*@media", r"^\s*\.\w+", r"^\s*#\w+"],
        "import": [r"^\s*import\s+.*from\s+", r"""^\s*import\s+[^'"\\s]+"""],
    },
    screens=("([A-Z][a-zA-Z0-9]+Page)",),
    components=(r"export\s+default\s+(\w+)", r"component\s+(\w+)"),
    priority_words=("index", "app", "main"),
    keywords=("web", "frontend", "react", "vue", "angular"),
)

PROFILES = {p.name: p for p in (_ANDROID, _IOS, _JAVA, _JAVASCRIPT, _PYTHON, _WEB)}
UNKNOWN = Profile(name="unknown")


def profile_for(name: str | None) -> Profile:
    """Profile of a project type; an unlisted type borrows the android one, ``unknown`` is empty."""
    if name is None or name == "unknown":
        return UNKNOWN
    return PROFILES.get(name, _ANDROID)


def indicator_table(spark: SparkSession, profiles: list[Profile] | None = None) -> DataFrame:
    """``profile_indicator(project_type, ord, indicator)``: the fixed detection dimension."""
    rows = [
        (p.name, order, indicator)
        for order, p in enumerate(profiles or list(PROFILES.values()))
        for indicator in p.indicators
    ]
    return spark.createDataFrame(rows, "project_type string, ord int, indicator string")


def extension_table(spark: SparkSession, profiles: list[Profile] | None = None) -> DataFrame:
    rows = [(p.name, e) for p in (profiles or list(PROFILES.values())) for e in p.extensions]
    return spark.createDataFrame(rows, "project_type string, extension string")


def ignore_table(spark: SparkSession, profile: Profile) -> DataFrame:
    """The ignore rules of one profile, applying from the project root."""
    return spark.createDataFrame([("", r) for r in profile.ignore], "dir string, rule string")


def level_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INDEX_LEVELS.items()), "intent string, level string")


def business_key_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUSINESS_KEYS.items()), "indicator string, index_key string")
