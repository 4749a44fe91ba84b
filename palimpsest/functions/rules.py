"""Literal strings whose exact text and order decide the results."""

# Ordered literal rewrites of edit comments (search, replacement).
COMMENT_REWRITES = [
    ("using [[Project:AWB|AWB]]", ""),
    ("using [[Projec|AWB]]", ""),
    ("using [[Project:AWB]]", ""),
    ("[[WP|Autowikibrowser]]", ""),
    ("[[WP|Autowikibrowser run]]", ""),
    ("with [[WP:AWB|AutoWikiBrowser]]", ""),
    ("with [[Project:AutoWikiBrowser|AWB]]", ""),
    ("[[WP:AWB\\/T|typo(s) fixed]]", " typo fixed"),
    ("[[WP:AWB\\/T|Typo fixing]]", " Typo fixing"),
    ("[[WP:AWB\\/T|typos fixed]]", " typos fixed"),
    ("[[WP:AWB\\/T|TypoFix]]", " typos fixed"),
    ("[[WP:AWB\\/T|typo fixing]]", " typo fixed"),
    ("[[WP:AWB/T|Typo fixing]]", " Typo fixing"),
    ("[[WP:AWB/T|typo(s) fixed]]", " typo fixed"),
    ("[[WP:AWB/T|typos fixed]]", " typos fixed"),
    ("[[WP:AWB/T|TypoFix]]", " typos fixed"),
    ("[[WP:AWB/T|typo fixing]]", " typo fixing"),
    ("[[WP:AWB/T|Typo]]", " typo fixing"),
    ("[[WP:TSN|Typo fixing]]", " typo fixing"),
    ("by [[wp:Typo_Team/moss]]", ""),
    ("by [[Wikipedia:Typo Team/moss]]", ""),
    ("from [[Wikipedia:Typo Team/moss/R]]", ""),
    ("[[WP|Typo fixing]]", " typo fixing"),
    ("[[WP|typos fixed]]", " typos fixed"),
    ("[[WP|typo fixing]]", " typo fixing"),
    ("[[WP|typo(s) fixed]]", " typo fixed"),
    ("[[WP|general]]", " general "),
    ("[[WP:RS|reliable sources]]", " reliable sources "),
    ("[[WP:RS]]", " reliable sources "),
    ("[[WP:OR]]", " original research "),
    ("[[WP:EUPHEMISM]]", " euphemisms "),
    ("[[WP:EDITORIAL]]", " editorial "),
    ("[[WP:TYPO]]", " typo fixing "),
    ("[[WP:AWB/T|Typo patrol]]", " typo patrol "),
    ("[[WP:EDITORIALISING]]", " editorializing "),
    ("[[hyphen]]", "hyphen"),
    ("[[WP:HYPHEN]]", "hyphen"),
    ("[[Wikipedia:GENFIXES|general fixes]]", " general fixes"),
    ("[[WP|general fixes]]", " general fixes"),
    ("[[WP:AWB/GF|General fixing]]", " general fixing"),
    ("[[WP:NPOV]]", " neutral point of view"),
    ("[[wp:npov|pov]]", " neutral point of view"),
    ("[[WP:NPOV|POV]]", " neutral point of view"),
    ("[[WP:point of view]]", " point of view"),
    ("[[WP:YESPOV|POV]]", " point of view"),
    ("[[WP:YESPOV]]", " point of view"),
    ("NPOV", " neutral point of view"),
    ("npov", " neutral point of view"),
    ("PoV", " point of view"),
    ("NPoV", " neutral point of view"),
    ("POV", "point of view"),
    (" pov ", " point of view "),
    ("pov.", "point of view."),
    ("(pov)", "(point of view)"),
    ("[[WP:AWB|AWB]]", ""),
    ("with [[Wikipedia:ProveIt|ProveIt]]", ""),
    ("using [[Wikipedia:ProveIt|ProveIt]]", ""),
    ("[[Wikipedia|ProveIt]]", " 'prove it'"),
    ("[[Wikipedia:ProveIt|ProveIt]]", ""),
    ("Typo/[[WP:AWB/GF|general]]", "Typo "),
    ("typo/[[WP:AWB/GF|general]]", "typo"),
    ("[[WP:AWB/GF|General fixes]]", "General fixes"),
    ("[[WP:AWB/GF|general fixes]]", "general fixes"),
    ("[[WP:RELTIME]]", "relative time references"),
    ("[[WP:AWB|Autowikibrowser run]]", "run"),
    ("[[WP:AWB|Autowikibrowser run]]", "run"),
    ("[[WP:PEACOCK|peacock words]]", " point of view and peacock words"),
    ("[[WP:PEACOCK|peacock word]]", " point of view and peacock word"),
    ("[[WP:PEACOCK]] term", " point of view and peacock term"),
    ("[[WP:PEACOCK]]", " point of view and peacock term"),
    ("[[WP:PEACOCK|peacock term]]", " point of view and peacock term"),
    ("[[WP:PEACOCK|subjective]]", " subjective and peacock word"),
    ("[[WP:PEACOCK|peacock]]", " peacock"),
    ("[[WP:PEACOCK|peacockery]]", " peacock"),
    ("[[WP:WEASEL|weasel word]]", " weasel word"),
    ("[[WP:WEASEL|weasel words]]", " weasel words"),
    ("[[WP:WEASEL]] word", " weasel word"),
    ("[[WP:WEASEL]]", " weasel word"),
    ("[[WP:LABEL]]", " contentious labels"),
    ("[[WP:NOR]]", " no original research"),
    ("[[WP:OR]]", " original research"),
    ("[[WP:ORIGINAL RESEARCH]]", " original research"),
    ("[[WP:ORIGINAL]]", " original research"),
    ("[[WP:SYN]]", " synthesis"),
    ("[[WP:SYNTH]]", " synthesis"),
    ("[[WP:POINT]]", " disrupt Wikipedia to illustrate a point"),
    ("[[WP:OPED]]", " Opinion Editorial"),
    ("[[WP:OPED|editorial]]", " Opinion Editorial"),
]

# Ordered markup replacements.
MARKUP_REWRITES = [
    ("&quot;", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("<ref>", ""),
    ("</ref>", ""),
    ("<\\/ref>", ""),
]
USER_LINK = r"\[\[User.*\]\]"

# Common entities, ampersand last so that nothing is decoded twice.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]

# Words and markers of the gates.
TOPIC_WORDS = ["POV", "中立", "偏见"]
COMMENT_BLACKLIST = [
    "template", "image", "infobox", "pic", "link", "photo",
    "comment", "http:", "https:", ".jpg", ".png", "reply",
]
COMMENT_MARKERS = ["MOS", "[[WP:CHECKWIKI]]", "[[WP|genfixes]]"]
BOT_MARKERS = ["[[Project:AWB|AWB]]", "[[Project:AutoWikiBrowser|AWB]]", "Undid revision"]
TOOL_SIGNATURES = ["(edited with [[User:ProveIt_GT|ProveIt]]", "// Edit via Wikiplus"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
TALK_WORDS = ["talk", "discuss"]

# Ordered token normalisations.
TOKEN_REWRITES = [("''", '"'), ("--", "—"), ("`", "'"), ("'ve", "' ve")]

# Delimiters and special tokens of the tagged-line format.
LABEL_SEP = "SEPL|||SEPR"
OP_SEP = "SEPL__SEPR"
START = "$START"
KEEP = "$KEEP"
DELETE = "$DELETE"
APPEND = "$APPEND_"
REPLACE = "$REPLACE_"
CASE_LOWER = "$TRANSFORM_CASE_LOWER"
CASE_CAPITAL = "$TRANSFORM_CASE_CAPITAL"
CASE_UPPER = "$TRANSFORM_CASE_UPPER"
CASE_CAPITAL_1 = "$TRANSFORM_CASE_CAPITAL_1"
CASE_UPPER_1 = "$TRANSFORM_CASE_UPPER_-1"
SPLIT_HYPHEN = "$TRANSFORM_SPLIT_HYPHEN"
SINGULAR = "$TRANSFORM_AGREEMENT_SINGULAR"
PLURAL = "$TRANSFORM_AGREEMENT_PLURAL"
VERB = "$TRANSFORM_VERB-"
MERGE_HYPHEN = "$MERGE_HYPHEN"
MERGE_SPACE = "$MERGE_SPACE"
DELETE_OPEN, DELETE_CLOSE = "[DELETE]", "[/DELETE]"
VERB_OPEN, VERB_CLOSE = "[TRANSFORM_VERB]", "[/TRANSFORM_VERB]"
MASK = "[MASK]"
IGNORE = -100
NUMBER = "#NUMBER"
