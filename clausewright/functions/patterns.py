"""Patterns of claim language, in Java's notation.

(?U) makes classes and \\b follow Unicode, (?u) case folding too, (?d) has only line feeds end a line.
"""

# What claim text looks like.
PAGE_ARTIFACT = r"(?miudU)^\s*(?:Page\s+\d+|\d+\s+of\s+\d+|-\s*\d+\s*-)\s*$"
OCR_FIXES = {
    "clalm": "claim",
    "clain": "claim",
    "cornprlsing": "comprising",
    "cornprising": "comprising",
    "whereln": "wherein",
}
SECTION_HEADER = r"(?miudU)^\s*(?:What\s+is\s+claimed\s+is\s*[:\.]|The\s+invention\s+claimed\s+is\s*[:\.]|We\s+claim\s*[:\.]|I\s+claim\s*[:\.]|CLAIMS?\s*[:\.]?)\s*$"
CLAIM_BOUNDARY = r"(?iuU)(?:^|\n)[ \t]*(?:claim[ \t]+)?(\d+)\.(?!\d)[ \t]*"
CLAIM_RANGE = r"(?iuU)\bclaims?\s+(\d+)\s*(?:-|to|through)\s*(\d+)\b"
CLAIM_EXPLICIT = r"(?iuU)(?:of|according\s+to|in|as\s+(?:recited|defined|set\s+forth)\s+in)\s+claim\s+(\d+)"
CLAIM_SINGLE = r"(?iuU)\bclaim\s+(\d+)\b"
CLAIM_LIST = r"(?iuU)\bclaims\s+(\d+(?:(?:\s*(?:,|-|and\b|or\b|to\b|through\b))+\s*\d+)*+)"
CLAIM_SPAN = r"(?iuU)(\d+)(?:\s*(?:-|to|through)\s*(\d+))?"
TRANSITION = r"(?iuU)\b(comprising|consisting\s+of|consisting\s+essentially\s+of|including|having|containing)\b"
CATEGORIES = {
    "method": r"(?iuU)\b(?:method|process)\b",
    "system": r"(?iuU)\bsystem\b",
    "apparatus": r"(?iuU)\b(?:apparatus|device|machine)\b",
    "composition": r"(?iuU)\bcomposition\b",
    "computer-readable medium": r"(?iuU)\b(?:computer[\s-]*readable\s+(?:storage\s+)?medium|non-transitory)",
    "article": r"(?iuU)\barticle\b",
    "product": r"(?iuU)\bproduct\b",
}
ENUMERATED = r"(?U)\([a-z]\)|\([A-Z]\)|\(\d+\)|\(i{1,3}\)|\(iv\)|\(vi{0,3}\)"
MARKER = r"(?iuU)\((?:[a-z]|i{1,3}|iv|vi{0,3}|ix|x|\d+)\)"
CONFIDENCE_WEIGHTS = {
    "claim_detection": 0.25,
    "dependency": 0.20,
    "transition": 0.15,
    "enumeration": 0.15,
    "semicolon": 0.10,
    "hierarchy": 0.15,
}

# What a text must hold for any of several patterns above to match; one pass without word boundaries tells.
ANY_OCR_ERROR = "(?iu)clalm|clain|cornpr|whereln"
ANY_CLAIM = "(?iu)claim"
ANY_NUMBERED_CLAIM = r"(?iuU)claims?\s+\d"
ANY_TRANSITION = "(?iu)compris|consist|includ|having|contain"
ANY_CATEGORY = "(?iu)method|process|system|apparatus|device|machine|composition|computer|transitory|article|product"
