"""Patterns and word lists whose every entry decides results.

They are written for engines without look-around, so that Spark and an SQL
oracle read the same text. ``WS`` is the white space of Unicode strings.
"""

# Fixed values
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAG = r"<[^>]+>"
NAMED_ENTITY = r"&[a-zA-Z]+;"
ENTITY = r"&[a-zA-Z]+;|&#[0-9]+;|&#x[0-9a-fA-F]+;"
HTTP_URL = r"https?://[^\x09-\x0d\x1c-\x20]+"
URL = r"https?://[^\x09-\x0d\x1c-\x20<>\"']+|www\.[^\x09-\x0d\x1c-\x20<>\"']+|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PLAIN_URL = r"https?://[^\x09-\x0d\x1c-\x20]+|www\.[^\x09-\x0d\x1c-\x20]+"
BLOCK = r"\{[^{}]*\}"
SCRIPT = r"function[\x09-\x0d\x20]*\(|var[\x09-\x0d\x20]+|let[\x09-\x0d\x20]+|const[\x09-\x0d\x20]+|=>[\x09-\x0d\x20]*\{"
XML_DECLARATION = r"<\?xml[^?]*\?>"
BASE64 = r"[A-Za-z0-9+/]{80,}"
MOJIBAKE = r"Ã©|Ã¨|Ã¡|Ã ','Ã¶|Ã¼|Ã®|Ã«|Ã£|Ãµ"
LINK_FARM = r"(?i)click here|buy now|visit us|order now|limited time|act now"
SEXUAL = r"(?i)escort|incall|outcall|brothel|hookup|hook up|one night stand|fuck|sex|nude|naked|porn|xxx|erotica|erotic|blowjob|handjob|cumshot|gangbang|threesome|strip[ps]|lapdance|stripper|adult dating|sugar daddy|sugar baby|live cam|webcam girl|cam show|sex toy|vibrator|dildo"
SERVICE = r"(?i)available for (?:incall|outcall)|call(?:s)? (?:now|me)|discreet (?:encounter|meeting|service)|no strings attached|personal (?:ads?|services?)|body rub|happy ending|fully nude|full service"
GAMBLING = r"(?i)casino|poker|blackjack|roulette|slots|jackpot|bet(?:ting|s)?|wager|gambl|online casino|live casino|mobile casino|free spins|bonus code|deposit bonus|play (?:now|free|for real)|real money (?:casino|slots|poker)|win (?:big|real|cash|money)"
OCR = r"[|}{][\x09-\x0d\x20]*[|}{]|(?:^|[\x09-\x0d\x20])[Il1|](?:$|[\x09-\x0d\x20])|â€™|Ã©|Ã¨|Ã¡|Ã ','Ã¶|Ã¼|Ã®|Ã«|Ã£|Ãµ|â€[cx]|â€œ|â€?"
ENGLISH = (  # the stop words of the language filter
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but",
    "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up", "out",
    "if", "about", "who", "get", "which", "go", "me", "when", "make", "can", "like", "time", "no", "just", "him", "know", "take", "people", "into",
    "year", "your", "good", "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come", "its", "over", "think", "also",
    "back", "after", "use", "two", "how", "our", "work", "first", "well", "way", "even", "new", "want", "because", "any", "these", "give", "day", "most",
    "us", "is", "are", "was", "were", "been", "being",
)
LEAKED_FORMAT = r"(?i)\{\{|\}\}|<<<|>>>|\[INST\]|\[/INST\]|###[\x09-\x0d\x20]*instruction|<\|.*?\|>|human:|assistant:"
DANGLING = r"\b(and|or|because|so|then|thus|therefore|,|;|:|\-)$"
HARMFUL = (r"(?i)\b(hate|racist|slur|nazi|kill|murder|suicide|bomb|terrorist)\w*", r"(?i)\b(porn|rape|abuse|pedophil)\w*")
HARMFUL_WORDS = tuple(w for p in HARMFUL for w in p[p.index("(", 4) + 1 : p.index(")", 4)].split("|"))  # any match has one, in lower case
STEP_MARK = r"(?i)step[\x09-\x0d\x20]*[0-9]+"
CONNECTIVE = r"(?i)\b(first|then|next|finally|therefore|because)\b"
CONTRADICTION = r"(?i)\b(contradiction|that's wrong|i made an error)\b"
TEACHER_PHRASES = ("as an ai", "as a language model", "i am an ai", "i'm an ai", "according to deepseek", "according to qwen", "according to glm")
ARTIFACT_LINES = (
    r"(?im)^as an ai[^.\n]*[.\n]",
    r"(?im)^i am (an|a) (ai|language model|large language)[^\n]*\n",
    r"(?im)^(certainly|sure|of course|absolutely|happy to help|here is|here's|below is)[,!]?[^\n]*\n",
    r"(?im)^according to (deepseek|qwen|glm|kimi|the model)[^\n]*\n",
    r"(?im)^(as a|being an?|since i am) (ai|language model|assistant)[^\n]*\n",
    r"(?im)^(hope this helps|let me know if|feel free to ask|does this help)[^\n]*[.\n]",
    r"(?im)^in conclusion,?[^\n]*\n",
    r"(?im)^note: as an ai[^\n]*\n",
    r"(?im)^<\|[^|]*\|>",
    r"(?im)^\[assistant\][^\n]*\n",
)
CONTEXT_LENGTHS = (256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
