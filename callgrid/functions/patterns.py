"""Patterns of personal data."""

# fixed values: an address of mail, a number of eight or more digits with separators, a labelled number, and
# (group 1 is the span) a name and an address
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
ACCOUNT = r"(?i)\b(?:account|policy|member|customer)\s*(?:number|no\.?|#)\s*[:#-]?\s*[A-Z0-9-]{5,}\b"
NAME = r"(?i)\b(?:my name is|this is|I am)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})"
ADDRESS = r"(?i)\b(?:address is|lives? at|located at)\s+([0-9]{1,6}\s+[A-Z0-9][A-Za-z0-9 .'-]{2,50})"
