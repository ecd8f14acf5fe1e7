"""Word lists, patterns, weights and thresholds that decide results.

They are kept together and in plain text because changing any of them changes answers.
"""

# --- fixed values: names of tables, columns and relationships ---------------------------------
TABLE_TYPE_MARKS = [
    ("fact", ["FACT"]),
    ("dimension", ["DIM"]),
    ("reference", ["REF", "REFERENCE", "LOOKUP"]),
    ("market_data", ["MARKET"]),
    ("calendar", ["CALENDAR"]),
]
COLUMN_CATEGORY_MARKS = [
    ("id", ["_sk", "_id", "id"]),
    ("key", ["_key", "key"]),
    ("code", ["_code", "code"]),
    ("date", ["date", "time", "timestamp"]),
    ("measure", ["amount", "price", "value", "quantity"]),
    ("type", ["type", "status", "flag"]),
    ("attribute", ["name", "description", "text"]),
]
VALUE_NODE_CATEGORIES = ["id", "key", "code", "type", "status"]
EDGE_WEIGHTS = {
    "foreign_key": 0.9,
    "primary_key": 0.8,
    "reference": 0.7,
    "similar": 0.6,
    "related": 0.5,
}
DEFAULT_EDGE_WEIGHT = 0.5

# --- fixed values: words looked for in questions ----------------------------------------------
BUSINESS_TERMS = [
    "trade", "trader", "execution", "venue", "product", "currency",
    "notional", "price", "cusip", "ticker", "counterparty", "etd",
    "source", "system", "business_date", "government", "entity",
]
BUSINESS_TERMS_SHORT = [
    "trade", "trader", "execution", "venue", "product", "currency",
    "notional", "price", "cusip", "ticker", "counterparty", "etd",
]
COLUMN_SUFFIXES = ["_id", "_key", "_sk", "_code", "_date", "_price", "_amount"]
STRIPPED_PUNCTUATION = ".,!?()[]"
INTENT_WORD_PATTERNS = [
    ("fact", "trade|transaction|execution|market|intra.?day"),
    ("dimension", "product|trader|venue|calendar|date|reference"),
    ("reference", "ref|lookup|master|code|type"),
]
INTENT_KEYWORDS = [
    (["fact"], ["trade", "transaction", "execution", "settlement"]),
    (["dimension", "reference"], ["product", "trader", "venue", "reference", "lookup"]),
    (["market_data"], ["market", "price", "quote", "intraday"]),
]
INTENT_DEFAULT = ["fact", "dimension", "reference"]
QUESTION_CATEGORIES = [
    ("Trade Queries", ["trade", "trading", "etd", "execution"]),
    ("Product Queries", ["product", "cusip", "instrument", "security"]),
    ("Entity Queries", ["counterparty", "trader", "entity", "government"]),
    ("Time-based Queries", ["yesterday", "last week", "date", "time"]),
    ("Currency Queries", ["currency", "exchange", "rate"]),
]
COMPLEX_MARKS = ["subquery", "union", "window", "cte", "recursive"]
MEDIUM_MARKS = ["join", "group by", "order by", "having"]
QUESTION_COLUMN_ALIASES = ["QUESTION", "Question", "question", "QUERY", "Query", "query"]
ANSWER_COLUMN_ALIASES = ["ANSWER", "Answer", "answer", "SQL", "sql", "GROUND_TRUTH", "Ground_Truth"]
ANSWER_SKIP_WORDS = [
    "table", "based", "the", "to", "for", "with", "contains",
    "provides", "analysis", "framework", "selected", "names",
    "response", "format", "task", "tables:",
]
HOSTED_MODEL_MARKS = ["GPT", "Gemini", "Azure"]

# --- fixed values: SQL keywords for pair scoring ----------------------------------------------
SQL_MATCH_KEYWORDS = [
    "SELECT", "FROM", "WHERE", "JOIN", "GROUP", "BY", "ORDER", "HAVING",
    "INNER", "LEFT", "RIGHT", "OUTER",
]
SQL_AGGREGATES = ["COUNT", "SUM", "AVG", "MAX", "MIN", "DISTINCT"]
SQL_PREDICATE_WORDS = ["AND", "OR", "NOT", "IN", "EXISTS"]
SQL_WEIGHTED_KEYWORDS = [
    "select", "from", "where", "group", "by", "order", "having",
    "join", "inner", "left", "right", "outer", "on", "and", "or",
]
SQL_REFERENCE_STOP = SQL_WEIGHTED_KEYWORDS + ["as", "distinct", "count", "sum", "avg", "max", "min"]
SQL_ENTITY_STOP = SQL_REFERENCE_STOP + [
    "case", "when", "then", "else", "end", "in", "not", "null", "is",
]
SQL_STRUCTURE_MARKS = ["SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "JOIN"]

# --- fixed values: weights and ladders --------------------------------------------------------
ENSEMBLE_WEIGHTS = [0.4, 0.3, 0.3]
EXECUTION_SCORE_WEIGHTS = {"execution": 0.4, "logical": 0.25, "partial": 0.2, "judge": 0.15}
TEXT_SCORE_WEIGHTS = {
    "exact_match": 0.15,
    "component_f1": 0.20,
    "bleu": 0.10,
    "code_bleu": 0.20,
    "structure": 0.10,
    "semantic": 0.10,
    "efficiency": 0.10,
    "soft_f1": 0.15,
    "judge": 0.15,
}
RECOMMENDATION_LADDER = [
    "Excellent for precise ranking (use when you need exact best table)",
    "Excellent for comprehensive retrieval (use for network traversal)",
    "Excellent for coverage (finds most relevant tables)",
    "Excellent for fast reliable retrieval",
    "Best for real-time applications (very fast)",
    "Good general-purpose method",
    "Specialized use cases only",
]
ADVICE = [
    ("exact_match", 0.5, "Focus on improving exact query structure and syntax"),
    ("component_f1", 0.7, "Review SQL components (SELECT, FROM, WHERE, etc.) for accuracy"),
    ("structure", 0.6, "Improve SQL syntax and structure formatting"),
    ("semantic", 0.6, "Focus on semantic correctness and logical equivalence"),
    ("efficiency", 0.7, "Optimize query efficiency and performance"),
]
ADVICE_NONE = "SQL quality is good overall! Continue refining for excellence."

# --- fixed values: words a TF-IDF model ignores unless the caller passes another list ---------
DEFAULT_STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for",
    "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "itself", "me", "more", "most", "my", "no",
    "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own",
    "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why",
    "will", "with", "would", "you", "your",
]
