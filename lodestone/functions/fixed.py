"""Fixed values that results depend on, stated as they are.

Patterns are written for Java. Where RE2, which DuckDB uses, needs another form, ``RE2_FORMS`` has it.
"""

from __future__ import annotations

# Words that are no keywords.
STOP_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "is", "are")

# Words that are no terms.
TERM_STOP_WORDS = ("the", "a", "an", "this", "that", "these", "those", "it", "its", "which", "who", "given", "such", "each", "every", "said", "same", "other")

# Ligatures and their letters.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))

# Our own values: scripts as character classes.
SCRIPTS = {"latin": "[A-Za-zÀ-ÖØ-öø-ÿ]", "devanagari": "[ऄ-हक़-ॡ]", "greek": "[Α-Ωα-ω]", "cyrillic": "[А-Яа-я]"}

# What the first words of a step may be.
STEP_MARKER = r"(?i)^\s*(?:step\s*\d+\b|[0-9]+[.)]|[a-z][.)]|first(?:ly)?\b|then\b|next\b|finally\b|lastly\b)"

# Sentences that define a term, with the term as their group.
DEFINED_FIRST = r"^([A-Z][A-Za-z][A-Za-z \-]{1,38})\s+(?:is|are)\s+defined as\b"
DEFINED_AFTER = r"(?i)\b(?:is|are)\s+(?:called|known as|referred to as)\s+(?:the\s+|an?\s+)?([A-Za-z][A-Za-z \-]{1,38}?)(?:[.,;:]|\s+and\b|$)"
DEFINED_DENOTES = r"\b([A-Z][A-Za-z][A-Za-z \-]{1,38})\s+denotes?\b"
DEFINED_BY_MEAN = r"(?i)\bby\s+([A-Z][A-Za-z][A-Za-z \-]{1,38})\s+we\s+mean\b"

# Languages of program text, the first that is found.
CODE_LANGUAGES = (
    ("python", r"(?m)\bdef\s+\w+\s*\(|\bimport\s+\w+|\bprint\s*\(|\belif\b|:\s*$"),
    ("java", r"\bpublic\s+(?:static\s+)?(?:void|class)\b|\bSystem\.out\.print"),
    ("javascript", r"\bfunction\s+\w+\s*\(|\bconst\s+\w+\s*=|\bconsole\.log\s*\("),
    ("sql", r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b"),
    ("c_cpp", r"(?m)#include\s*[<\"]|\bvoid\s+main\s*\(|\bprintf\s*\(|;[ \t]*$"),
    ("pseudocode", r"(?i)\b(?:begin|end|procedure|function|input|output|algorithm|pseudocode)\b"),
)

# Constructs of program text.
CODE_CONSTRUCTS = (
    ("loop", r"(?i)\bfor\b|\bwhile\b|\brepeat\b|\bdo\b"),
    ("conditional", r"(?i)\bif\b|\belse\b|\belif\b|\bswitch\b|\bcase\b"),
    ("function_def", r"(?i)\bdef\s+\w+\s*\(|\bfunction\s+\w+\s*\(|\bvoid\s+\w+\s*\(|\bprocedure\s+\w+"),
    ("class_def", r"(?i)\bclass\s+\w+"),
    ("import_statement", r"(?i)\bimport\s+\w+|\binclude\b"),
    ("assignment", r"(?<![=!<>])=(?!=)"),
    ("return_statement", r"(?i)\breturn\b"),
    ("print_statement", r"(?i)\bprint\s*\(|\bprintf\s*\(|\bconsole\.log\s*\(|\bSystem\.out\.print"),
    ("exception_handling", r"(?i)\btry\b|\bcatch\b|\bexcept\b|\bfinally\b|\bthrow\b|\braise\b"),
    ("comment", r"(?m)^\s*#|^\s*//|/\*|\*/"),
)

# Words, in lower case, without one of which a language's or a construct's pattern is not found.
CODE_WORDS = {
    "python": ("def", "import", "print", "elif", ":"), "java": ("public", "system.out"), "javascript": ("function", "const", "console.log"), "sql": ("select", "insert", "update", "delete", "from", "where"),
    "c_cpp": ("#include", "void", "printf", ";"), "pseudocode": ("begin", "end", "procedure", "function", "input", "output", "algorithm", "pseudocode"),
    "loop": ("for", "while", "repeat", "do"), "conditional": ("if", "else", "switch", "case"), "function_def": ("def", "function", "void", "procedure"), "class_def": ("class",), "import_statement": ("import", "include"),
    "assignment": ("=",), "return_statement": ("return",), "print_statement": ("print", "console.log"), "exception_handling": ("try", "catch", "except", "finally", "throw", "raise"), "comment": ("#", "//", "/*", "*/"),
}

# The same in RE2's form, where that lacks what Java's has.
RE2_FORMS = {
    r"(?<![=!<>])=(?!=)": r"(?:^|[^=!<>])=(?:[^=]|$)",
}

# Phrases that refer to other parts of a text.
CROSS_REFERENCES = (
    ("figure", r"(?i)\b(?:refer(?:ring)?\s+to|as\s+shown\s+in|see)\s+(?:the\s+)?(?:figure\s*[\d.]*)"),
    ("table", r"(?i)\b(?:refer(?:ring)?\s+to|as\s+shown\s+in|see)\s+(?:the\s+)?(?:table\s*[\d.]*)"),
    ("equation_or_formula", r"(?i)\b(?:using|from)\s+the\s+(?:above|following|previous)\s+(?:formula|equation)\b"),
    ("definition", r"(?i)\baccording\s+to\s+the\s+(?:above|previous|following)\s+definition\b"),
    ("concept_or_topic", r"(?i)\bas\s+(?:discussed|explained|described|mentioned)\s+(?:above|earlier|previously)\b"),
)

# Role pairs, the relationship that joins them, its direction, weight and rule.
ROLE_RULES = (
    ("defines_concept", "defines_concept", "DEFINES", "FORWARD", 0.90, "rule_defines_concept"),
    ("defines_concept", "states_prerequisite", "REQUIRES", "FORWARD", 0.85, "rule_requires_prerequisite"),
    ("states_learning_objective", "states_prerequisite", "REQUIRES", "FORWARD", 0.80, "rule_objective_requires_prerequisite"),
    ("exemplifies_concept", "defines_concept", "ILLUSTRATES", "FORWARD", 0.85, "rule_illustrates_concept"),
    ("serves_visual_purpose", "defines_concept", "EXPLAINS", "FORWARD", 0.80, "rule_figure_explains_concept"),
    ("references_concepts_visually", "defines_concept", "EXPLAINS", "FORWARD", 0.78, "rule_visual_reference_explains"),
    ("fulfills_teaching_function", "defines_concept", "EXPLAINS", "FORWARD", 0.75, "rule_teaching_function_explains"),
    ("states_scientific_goal", "frames_reasoning", "SUPPORTS", "FORWARD", 0.82, "rule_scientific_supports_reasoning"),
    ("directs_observation", "frames_reasoning", "SUPPORTS", "FORWARD", 0.78, "rule_observation_supports_reasoning"),
    ("states_scientific_goal", "defines_concept", "SUPPORTS", "FORWARD", 0.75, "rule_scientific_goal_supports_concept"),
    ("sequences_instruction", "describes_strategy", "IMPLEMENTS", "FORWARD", 0.82, "rule_sequence_implements_strategy"),
    ("sequences_instruction", "sequences_instruction", "SEQUENCES", "FORWARD", 0.70, "rule_sequence_to_sequence"),
    ("states_learning_objective", "defines_concept", "EVALUATES", "FORWARD", 0.80, "rule_objective_evaluates_concept"),
    ("states_learning_objective", "states_learning_objective", "EVALUATES", "FORWARD", 0.75, "rule_objective_to_objective"),
    ("enables_transfer", "defines_concept", "EXTENDS", "FORWARD", 0.78, "rule_transfer_extends_concept"),
    ("enables_transfer", "describes_strategy", "EXTENDS", "FORWARD", 0.75, "rule_transfer_extends_strategy"),
    ("surfaces_misconception", "defines_concept", "CONTRADICTS", "FORWARD", 0.88, "rule_misconception_contradicts_concept"),
    ("frames_teaching_intent", "defines_concept", "CONTEXTUALIZES", "FORWARD", 0.75, "rule_teaching_intent_contextualizes"),
    ("frames_reasoning", "defines_concept", "CONTEXTUALIZES", "FORWARD", 0.72, "rule_reasoning_contextualizes"),
    ("expresses_comparison", "conveys_relationship", "REFERENCES", "FORWARD", 0.68, "rule_comparison_references_relationship"),
    ("conveys_relationship", "defines_concept", "REFERENCES", "FORWARD", 0.68, "rule_relationship_references_concept"),
    ("serves_educational_purpose", "defines_concept", "REFERENCES", "FORWARD", 0.65, "rule_educational_purpose_references"),
    ("fulfills_teaching_function", "sequences_instruction", "SUMMARIZES", "FORWARD", 0.70, "rule_teaching_function_summarizes"),
)
FALLBACK_RULE = ("RELATED_TO", "BIDIRECTIONAL", 0.3)

# Shapes of lines that recognisers look for.
VARIABLE_ONLY = r"^[A-Za-z][A-Za-z0-9\s+\-*/^().]*=[A-Za-z\s+\-*/^().]+$"
NUMERIC_SUBSTITUTION = r"^[A-Za-z]?\s*=?\s*[\d.\s+\-*/^().×xX÷]+$"
TRIG_LOG = r"(?i)\b(?:sin|cos|tan|cot|sec|cosec|log|ln)\b"
IDENTITY_HINT = r"(?i)\b(?:identity|identities)\b"
IDENTITY_SHAPE = r"^[A-Za-z][A-Za-z0-9\s+\-*/^().]*=[A-Za-z0-9\s+\-*/^().]+$"
CHEM_ARROW = r"(?:->|→|⇌|=>)"
CHEM_TOKEN = r"[A-Z][a-z]?\d*"
ECON_KEYWORDS = r"(?i)\b(?:GDP|GNP|NNP|NDP|MPC|MPS|APC|APS|elasticity|equilibrium|national income)\b"
ECON_LEFT = r"(?i)^\s*(?:GDP|GNP|NNP|NDP)\b"
ALIGNMENT = r"(?:&=|\\\\|\.\.\.)"
CONTINUATION = r"^\s*[=+\-*/]"
SOLUTION = r"(?i)^\s*(?:solution|answer|method|approach)\b"
GIVEN_FIND = r"(?i)^\s*(?:given|find|to prove|to show|required|prove that)\b"
ALGORITHM = r"(?i)\b(?:input|output|repeat|while|if\s+.+\s+then|algorithm|pseudocode)\b"
JOURNAL = r"(?i)\b(?:dr\.?|cr\.?|debit|credit|journal entry|ledger)\b"
CODE_HINT = r"(?:\bdef\s+\w+\s*\(|\bprint\s*\(|\bimport\s+\w+|\bfor\s+\w+\s+in\s+|#include|\bvoid\s+main|\bclass\s+\w+|\breturn\b|;\s*$|\{|\})"
# The same by its alternatives, each with a word that it cannot do without; none where the word is all of it.
CODE_HINTS = (
    ("{", None), ("}", None), ("#include", None), (";", r";\s*$"), ("def", r"\bdef\s+\w+\s*\("), ("print", r"\bprint\s*\("), ("import", r"\bimport\s+\w+"),
    ("for", r"\bfor\s+\w+\s+in\s+"), ("void", r"\bvoid\s+main"), ("class", r"\bclass\s+\w+"), ("return", r"\breturn\b"),
)
PSEUDOCODE = r"(?i)\b(?:begin|end|procedure|function|input|output)\b"
JOURNAL_HEADER = r"(?i)\b(?:date|particulars?|l\.?\s?f\.?|debit|credit|amount)\b"
LEDGER_HEADER = r"(?i)\b(?:dr\.?|cr\.?)\b.*\b(?:ledger|account)\b"
GOLDEN_RULE = r"(?i)\b(?:debit the receiver|credit the giver|debit what comes in|credit what goes out|debit all expenses(?: and losses)?|credit all incomes?(?: and gains)?)\b"
FLOWCHART = r"(?i)\b(?:flow\s*chart|flowchart|start\b|end\b|decision\b|process\b)\b"
GRAPH = r"(?i)\b(?:graph|axis|x-axis|y-axis|plot|curve|slope)\b"
CIRCUIT = r"(?i)\b(?:circuit|resistor|voltmeter|ammeter|capacitor|battery|ohm)\b"
CONCEPT_TABLE = r"(?i)\b(?:comparison|difference between|differences?|types? of|classification|versus|vs\.?)\b"
PROSE_SENTENCE = r"[.!?]\s+[A-Z]"
FIGURE_CAPTION = r"(?i)^\s*(?:fig(?:ure)?\.?\s*\d+|plate\s*\d+|photo(?:graph)?\s*\d+)"
LIFE_CYCLE = r"(?i)\b(?:life\s*cycle|stages? of|phases? of)\b"
MAP = r"(?i)\b(?:map|geographical|topographic|contour)\b"
ANATOMY = r"(?i)\b(?:anatomy|structure of|cross.?section|longitudinal section)\b"

# The parts of headings.
ROMAN_3999 = r"(?i)^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
NUMBERED_HEADING = r"^(0|[1-9]\d{0,2})([.)])?$"
CHAPTER_WORDS = ("chapter", "unit", "lesson")
SMALL_TITLE_WORDS = ("a", "an", "the", "of", "and", "or", "in", "on", "to", "for", "with", "our")
HEADING_PRIORITY = {"chapter_number": 5, "hierarchical": 10, "numbered": 20, "roman": 30, "alphabetic": 40, "chapter_title": 90}
