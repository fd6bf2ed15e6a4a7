"""Word lists, weights and patterns of the English rules. All are parameters of the functions that use them."""

from __future__ import annotations

# The default English lexicons, severities and points. Findings, and so the snippets that a report shows,
# come in the order of these lists.
BANNED = (
    "in today's world", "in today's fast-paced", "in the modern world", "gone are the days", "when it comes to", "at the end of the day",
    "let's dive in", "let's delve", "dive deep", "in conclusion", "in summary", "it is important to note", "it's worth noting",
    "needless to say", "last but not least", "first and foremost", "the world of", "navigate the", "navigating the", "unlock the",
    "unleash the", "harness the power", "take it to the next level", "a testament to", "plays a crucial role", "plays a vital role",
    "plays a pivotal role", "in the realm of", "ever-evolving", "ever-changing", "fast-paced world", "digital age", "game-changer",
    "tapestry", "rich tapestry", "whether you're", "look no further",
)
HOLLOW = (
    "seamless", "seamlessly", "robust", "powerful", "comprehensive", "cutting-edge", "state-of-the-art", "revolutionary", "groundbreaking",
    "innovative", "world-class", "best-in-class", "unparalleled", "leverage", "leveraging", "elevate", "empower", "streamline", "optimize",
    "holistic", "synergy", "paradigm", "transformative", "delve", "underscore", "pivotal", "myriad", "plethora", "bustling", "meticulous",
    "meticulously", "vibrant", "crucial", "vital",
)
OPENERS = (
    "in today", "imagine a world", "picture this", "in conclusion", "in summary", "to sum up", "when it comes to", "at the end of the day",
    "in the world of", "in the realm of", "as we", "in this article", "in this guide", "let's", "firstly", "secondly", "thirdly",
    "moreover", "furthermore", "additionally", "overall",
)
HEDGES = (
    "perhaps", "might", "maybe", "arguably", "somewhat", "generally", "typically", "often", "usually", "fairly", "relatively", "possibly",
    "seemingly", "kind of", "sort of", "in some ways", "to some extent", "it could be argued", "one could say",
)
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "cf", "al", "fig", "no", "inc", "ltd", "co")
FUNCTION_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "for", "it", "with", "as", "was", "on", "be", "this", "by", "an", "are", "at", "from",
    "or", "we", "you", "not", "but", "have", "has", "they", "their", "which", "a",
)
#: Phrase to replacement; an empty one deletes.
FIXES = {
    "seamless": "smooth", "seamlessly": "smoothly", "robust": "solid", "powerful": "strong", "comprehensive": "complete",
    "cutting-edge": "new", "state-of-the-art": "advanced", "revolutionary": "new", "groundbreaking": "new", "innovative": "new",
    "leverage": "use", "leveraging": "using", "elevate": "raise", "streamline": "simplify", "optimize": "improve", "myriad": "many",
    "plethora": "many", "meticulous": "careful", "meticulously": "carefully", "vibrant": "lively", "bustling": "busy", "crucial": "key",
    "vital": "key", "pivotal": "key", "delve": "dig", "underscore": "highlight", "in today's world": "", "in the modern world": "",
    "it is important to note": "", "it's worth noting": "", "needless to say": "", "first and foremost": "", "last but not least": "",
    "in conclusion": "", "in summary": "",
}
SEVERITY = {"banned-phrase": "high", "hollow-confidence": "med", "triad": "low", "negation-pivot": "high", "hedge-stack": "low", "cliche-opener": "low"}
POINTS = {"high": 6, "med": 4, "low": 2}
RULES = tuple(SEVERITY)
#: Upper score of each grade but the last.
GRADES = (("A", 10), ("B", 25), ("C", 45), ("D", 70))
PROSE_EXTENSIONS = ("md", "markdown", "mdx", "txt", "html", "htm", "rst")
#: A page of fewer words shows no score.
LEAST_PAGE_WORDS = 6
#: What a grade says, and its class.
VERDICTS = {"A": "Reads human.", "B": "Mostly human. A couple of tells.", "C": "Some robotic texture.", "D": "Reads machine-made.", "F": "Heavily robotic."}
BUCKETS = {"A": "good", "B": "good", "C": "warn", "D": "bad", "F": "bad"}
SKIPPED_FOLDERS = ("node_modules", "dist", "build", "out", "target", "vendor", "coverage", ".next", ".cache")
#: Replaced one after another, so the ampersand comes last: what it gives is never read as a reference again.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–",
    "&hellip;": "…", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&middot;": "·", "&amp;": "&",
}
MAX_INPUT_BYTES = 5 * 1024 * 1024

#: White space, as one class that Java's and RE2's engines read alike.
WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The letters one by one: Java's engine looks up a class of single Latin-1 characters in one step, ranges and others one after another.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_NARROW = r"\t\n\x{0B}\f\r\x{A0}"
#: White space beyond Latin-1, and runs of Latin-1 white space that are not one blank.
WIDE_SPACE, UNEVEN_SPACE = r"[\x{1680}-\x{FEFF}](?<=[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}])", f"[{_NARROW} ](?:(?<=[{_NARROW}])[{_NARROW} ]*|[{_NARROW} ]+)"
WORD = "[a-z][a-z'’-]*"
#: Words of lower-case text without curly quotes.
STRAIGHT_WORD = f"[a-z][{LETTERS}'-]*"
#: There, words of at least five letters and marks that end in ``ly``: nearly all have a letter five places before their end. A
#: text with a mark there is read word by word.
ADVERB, ADVERB_SIGN = f"ly(?![{LETTERS}'-])(?<=[{LETTERS}][{LETTERS}'-]{{2}}ly)", f"ly(?![{LETTERS}'-])(?<=['-][{LETTERS}'-]{{2}}ly)"
ANY_ADVERB = f"(?<![{LETTERS}'-])['-]*+[a-z][{LETTERS}'-]{{4,}}+(?<=ly)"
#: The patterns of the seesaw and of three-item lists. ``\b`` is ASCII; see :func:`ascii_bounds`.
PIVOTS = (
    r"\bit'?s not (?:about |just )?[^.,;]{2,40}?[,;.]?\s*it'?s\b",
    r"\bnot (?:just|only|merely) [^.,;]{2,40}?(?:,|;| but| but rather| but also)\b",
    r"\bisn'?t (?:about|just) [^.,;]{2,40}?[,;.]?\s*it'?s\b",
    r"\bthis isn'?t [^.,;]{2,40}?\.\s*(?:this is|it'?s)\b",
    r"\b(?:do|does|did|is|was|are|were|ca|wo|would|could|should)n'?t (?:just|only|merely) [^.,;]{2,40}?[,;]",
)
TRIAD = r"\b[\w'’-]+,\s+[\w'’-]+,\s+(?:and|or)\s+[\w'’-]+"
#: What each seesaw and each three-item list holds; looked for first, since it is found or missed much sooner than they are.
PIVOT_SIGN = (
    r"[nN](?:[oO][tT] (?<=[sS] ....)|'?[tT] (?<=[iI][sS][nN]'?[tT] )"
    r"|[oO']?[tT] (?:[aA][bB][oO][uU][tT]|[jJ][uU][sS][tT]|[oO][nN][lL][yY]|[mM][eE][rR][eE][lL][yY]))"
)
TRIAD_SIGN = r",\s+(?:[aA][nN][dD]|[oO][rR])\s"
DASHES = "—|--|&mdash;"
#: Comments, elements without visible text, ends of blocks, line breaks and other tags of HTML. RE2 and Java read them alike.
HTML_COMMENT, HTML_HIDDEN = r"<!--[\s\S]*?-->", r"(?i)<script(?:[^A-Za-z0-9_>][^>]*)?>[\s\S]*?</script>|<style(?:[^A-Za-z0-9_>][^>]*)?>[\s\S]*?</style>"
HTML_BLOCK_END = f"(?i)</(?:p|div|li|h[1-6]|section|article|header|footer|blockquote|tr|figcaption){WS}*>"
HTML_BREAK, HTML_TAG = f"(?i)<br{WS}*/?>", "<[^>]+>"
#: How a line of an interface begins, which is no prose; what a uniform rhythm is called.
CHROME = f"(?i)^(like|comment|share|reply|follow|following|see more|view|edited|[0-9]+{WS}*(likes?|comments?|shares?)|[0-9]+[hdwmy]|·)"
UNIFORM_NOTE = "every sentence the same length"


def ascii_bounds(pattern: str) -> str:
    """The pattern for Java's engine, whose own ``\\b`` takes letters beyond ASCII for parts of words."""
    w = f"[{LETTERS}{LETTERS.upper()}0123456789_]"
    return pattern.replace(r"\b", f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))")


def alternation(phrases: tuple[str, ...]) -> str:
    """One expression of all phrases, longer ones first, so that none hides a longer one that begins alike."""
    import re

    return "|".join(re.escape(p).replace(r"\ ", " ").replace(r"\-", "-") for p in sorted(phrases, key=lambda p: (-len(p), p)))


def branching(phrases: tuple[str, ...]) -> str:
    """An expression that matches where a phrase begins to stand whole, with equal beginnings written once."""
    import re

    tree: dict = {}
    for p in phrases:
        at = tree
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        if "" in at:
            return ""
        branches = [(c if c in " -'" else re.escape(c)) + written(below) for c, below in sorted(at.items())]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return written(tree)


def bounded(phrases: tuple[str, ...]) -> str:
    """Phrases between characters that are neither a letter of a-z nor an apostrophe, in lower-case text, for Java's engine."""
    return f"(?<![a-z'])(?:{alternation(phrases)})(?![a-z'])"


def overlap_free(phrases: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Phrases in groups in which no two can overlap in a text, so that one alternation a group counts every hit."""

    def clash(a: str, b: str) -> bool:
        joins = any(a[i:] == b[: len(a) - i] and (i == 0 or not a[i - 1].isalpha()) and (len(a) - i == len(b) or not b[len(a) - i].isalpha()) for i in range(len(a)) if len(a) - i <= len(b))
        return joins or f" {b} " in f" {a} "

    groups: list[list[str]] = []
    for p in phrases:
        for g in groups:
            if not any(clash(p, q) or clash(q, p) for q in g):
                g.append(p)
                break
        else:
            groups.append([p])
    return [tuple(g) for g in groups]
