"""Regular expressions and phrases of the report cleaning rules.

Patterns are written without flags; the functions that use them add the flags.
Order matters wherever a tuple is applied as a cascade.
"""

SECTION_HEADERS = ("FINDINGS", "IMPRESSION", "CONCLUSION", "RECOMMENDATION", "OPINION")

# a report with any of these is rejected
TOXIC = (
    r"(?:communicated|paged|discussed|notified|contacted|telephoned|called\s+to)",
    r"read\s+back",
    r"(?:Dr\.|physician|radiologist).{0,30}(?:aware|contact|note|discuss)",
    r"(?:signed|dictated)\s+by",
)

# of these words, in lower case, every text with a match of TOXIC holds at least one
TOXIC_WORDS = (
    "communicated", "paged", "discussed", "notified", "contacted", "telephoned", "called", "back", "dr.", "physician", "radiologist",
    "signed", "dictated",
)

# applied with case as written
CLOCK_TIME = r"\d{1,2}:\d{2}\s*(?:a\.m\.|p\.m\.|AM|PM|am|pm)"

BENIGN_NOISE = (
    r"technique\s*:.*?(?:\.|$)",
    r"differences\s+in\s+technique.*?(?:\.|$)",
    r"comparison\s*(?:is)?\s*(?:made\s*)?(?:to|with).*?(?:\.|$)",
    r"(?:in\s+)?(?:direct\s+)?comparison\s+(?:is\s+)?(?:made\s+)?(?:to|with|from).*?(?:\.|$)",
    r"compared\s+(?:to|with|from).*?(?:\.|$)",
    r"intervals?\s+change(?:s)?\s+(?:since|from).*?(?:\.|$)",
    r"unchanged\s+compared\s+(?:to|with).*?(?:\.|$)",
    r"in\s+(?:with\s+)?the\s+study\s+of.*?(?:\.|$)",
    r"\bagain\b\s*",
    r"\bprior\s+(?:study|exam|radiograph|film|images)\b",
    r"\bprevious\s+(?:study|exam|radiograph|film|images)\b",
    r"(?:on|dated)\s+\.\s",
    r"signed\s+by.*?(?:\.|$)",
    r"dictated\s+by.*?(?:\.|$)",
)

VIEW_PHRASES = (
    r"(?:frontal|PA|AP)\s+(?:and|&)\s+lateral\s+(?:views?|radiographs?|images?).*?(?:\.|$)",
    r"(?:single\s+)?(?:portable\s+)?(?:conventional\s+)?(?:AP|PA|frontal|lateral|upright|supine|semi-upright)\s+(?:portable\s+)?(?:view|radiograph|image|chest|film)s?\s+(?:of\s+the\s+chest)?.*?(?:\.|$)",
    r"^AP\s+chest\.?$",
    r"(?:on\s+)?(?:the\s+)?(?:frontal|lateral|PA|AP)\s+(?:view|radiograph|image)s?.*?(?:shows|demonstrates|is|pres)",
    r"(?:frontal|lateral)\s+view.*?(?:\.|$)",
    r"(?:portable\s+)?(?:upright\s+)?views?\s+(?:of\s+the\s+chest\s+)?(?:are|were)\s+obtained.*?(?:\.|$)",
)

# words, in lower case: every text that the pattern matches holds one of them unbroken
NEEDED_WORDS = dict(
    zip(
        BENIGN_NOISE + VIEW_PHRASES,
        [
            ("technique",), ("differences",), ("comparison",), ("comparison",), ("compared",), ("interval",), ("unchanged",), ("study",),
            ("again",), ("prior",), ("previous",), (), ("signed",), ("dictated",),
            ("lateral",), ("view", "radiograph", "image", "chest", "film"), ("chest",), ("view", "radiograph", "image"), ("view",), ("view",),
        ],
        strict=True,
    )
)

GHOST_WORDS = (
    r"As",
    r"In",
    r"Therefore",
    r"However",
    r"When",
    r"Thus",
    r"The",
    r"As\s+a\s+consequence",
    r"As\s+previously",
    r"In\s+the",
    r"In\s+addition",
)

# second pass over already cleaned reports
RESIDUAL_NOISE = (
    # people
    r"[^.]*?(?:conveyed|relayed|discussed|communicated) by Dr\.[^.]*?\.",
    r"[^.]*?findings? (?:were|was) (?:conveyed|relayed|discussed)[^.]*?\.",
    r"[^.]*?by Dr\. \w+ to Dr\. \w+[^.]*?\.",
    r"[^.]*?Dr\. \w+[^.]*?(?:telephone|phone|pager)[^.]*?\.",
    # clock times
    r"[^.]*?(?:done|obtained|performed) at \d{2}:\d{2}[^.]*?\.",
    r"[^.]*?(?:examination|study) done at[^.]*?\.",
    r"[^.]*?at \d{2}:\d{2}[^.]*?(?:hours|on)[^.]*?\.",
    r"\d{2}:\d{2}(?:\s+hours)?",
    # messages
    r"[^.]*?(?:telephone|phone|pager)[^.]*?at \d{2}:\d{2}[^.]*?\.",
    r"[^.]*?pager was placed[^.]*?\.",
    r"[^.]*?min(?:utes)? after[^.]*?\.",
    r"[^.]*?results were conveyed[^.]*?\.",
    # administration
    r"Analysis is performed in direct\s*",
    r"\d{2}:\d{2}\s+is submitted\.?",
    r"[^.]*?is submitted[^.]*?\.",
    r",\s*MD\s*=\s*CC:\s*DR\..*",
    r"Dictated by[^.]*?\.",
    r"Attending:[^.]*?\.",
    r"Resident:[^.]*?\.",
    # remains
    r"\s+text\s+on\s+at\s*",
    r"Findings:\s*$",
    r"Impression:\s*$",
    r"\s{2,}",
)
LEADING_CONJUNCTION = r"^\s*(?:and|but|or|however|therefore)\s+"

METRIC_HEADERS = r"\b(findings|impression|conclusion|history|comparison)\b\s*:\s*"

# a line holding one of these is dropped from displayed text
DISPLAY_MARKERS = (
    "CLINICAL CONTEXT",
    "[CHECK]",
    "[Context]",
    "[History]",
    "You are a radiologist",
    "Task:",
    "EXPECTED:",
)
