"""The text patterns and word lists that results depend on.

Patterns are written as Python's `re` reads them; `java()` gives the same pattern for the
JVM, Unicode classes on.
"""

from __future__ import annotations

import re

UNICODE = "(?U)"
EMAIL = r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])"
PHONE = r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"
WHOLE_DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
PHONE_DIGITS = 9
NATIONAL_ID = r"(?<!\d)\d{17}[\dXx](?!\d)"
POSTCODE = r"(?i)(?<!\w)(?:GIR ?0AA|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})(?!\w)"
IP_TOKEN = r"(?<![\w:])(?:[0-9A-Fa-f:.]{3,})(?![\w:])"
IP_TRIM = "[](),;."
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
LOOSE_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
LOOSE_IPV4 = rf"(?<!\d){LOOSE_OCTET}(?:\.{LOOSE_OCTET}){{3}}(?!\d)"

ENTITIES = ("email", "phone", "cn_national_id", "uk_postcode", "ip_address")

NUMBER_TOKEN = r"(?<!\w)\d[\d./:-]*"
LONG_WORD = r"[^\W\d_][\w'-]{7,}"

# Column names, lower case: the first list that matches decides, in this order.
IDENTIFIER_NAMES = (
    r"(^|_)(name|full_name|first_name|last_name)(_|$)",
    r"phone|mobile|telephone|tel",
    r"email|e_mail",
    r"(^|_)(id|subject_id|participant_id|patient_id|student_id|employee_id|record_id)(_|$)|passport|nhs|ssn|national_id|identity|id_card|身份证|手机号|电话|邮箱|姓名|护照|学号|工号|病历号",
    r"(^|_)(uid|uuid|guid|mrn|medical_record|account_number|account_no|acct_number|acct_no|member_number|member_no|case_number|case_no|imei|imsi|iccid)(_|$)",
    r"address|postcode|postal|zip|住址|地址|邮编",
)
QUASI_NAMES = (
    r"(^|_)(age|dob|birth|birthday|sex|gender|ethnicity|nationality|occupation|job|school|university|city|region|country)(_|$)",
    r"年龄|生日|出生|性别|民族|国籍|职业|学校|大学|城市|地区|国家",
)
SENSITIVE_NAMES = (
    r"diagnos|disease|symptom|medicat|health|clinical|hospital|condition|therapy|trauma|psychi|mental",
    r"phq|gad|cape|pcl|score|scale|questionnaire|rt|reaction_time",
    r"诊断|疾病|症状|药物|健康|临床|医院|治疗|创伤|心理|精神|量表|评分|反应时",
)

OFFICIAL_HOSTS = {
    "api.openai.com": "OpenAI",
    "api.anthropic.com": "Anthropic",
    "generativelanguage.googleapis.com": "Google Gemini",
    "api.mistral.ai": "Mistral AI",
    "api.cohere.com": "Cohere",
    "api.groq.com": "Groq",
    "api.deepseek.com": "DeepSeek",
    "api.x.ai": "xAI",
}
ROUTER_HOSTS = {"openrouter.ai": "OpenRouter", "api.openrouter.ai": "OpenRouter"}
MANAGED_SUFFIXES = {".openai.azure.com": "Microsoft Azure OpenAI", ".services.ai.azure.com": "Microsoft Azure AI"}
SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "x-api-key", "api-key", "cookie", "set-cookie")
SENSITIVE_QUERY = r"(?i)(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth|signature|secret|password|code)"
SECRET_FIELD = r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|authorization|password|secret)(?![A-Za-z0-9])"

# Limits of the text audit, and of evidence for row-level release.
MAX_NGRAM_REUSE, MAX_TOKEN_REUSE, MIN_OUTPUT_CHARS = 0.01, 0.05, 80
MAX_NEAR_COPY, MAX_AUC, MAX_UPLIFT, MAX_LINKAGE = 0.01, 0.60, 0.10, 0.05

# Entity types of nominated literals, by priority, and those with the shorter length limit.
LITERAL_TYPES = ("PERSON", "ALIAS", "ORGANIZATION", "LOCATION", "PROJECT", "DATE", "ROLE", "EVENT", "QUASI_IDENTIFIER")
SHORT_TYPES = ("ROLE", "EVENT", "QUASI_IDENTIFIER")
# Identifier spans that start together and are equally long: the first of these wins.
SPAN_PRIORITY = ("NATIONAL_ID", "EMAIL", "POSTCODE", "IP_ADDRESS", "PHONE")


#: Word characters as Python reads them: letters and numbers of any script, and the underscore. Java's own class holds combining
#: marks, joiners and connectors too, and lacks superscripts and fractions.
WORD, NO_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def java(pattern: str) -> str:
    return UNICODE + pattern.replace(r"\w", WORD).replace(r"\W", NO_WORD)


def python(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern)
