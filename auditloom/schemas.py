"""Declared schemas and fixed rule tables."""

from pyspark.sql import types as T

CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

REPORT_SCHEMA = (
    "struct<url:string,pages_crawled:int,pages_scored:int,pages_unreachable:int,overall_score:int,semantic_score:int,"
    "findings:array<string>,recommendations:array<string>,"
    "semantic_findings:array<string>,semantic_recommendations:array<string>,crawl_duration_seconds:double>"
)

JOB_STATUSES = ["PENDING", "STARTED", "CRAWLING", "SCORING", "SUCCESS", "FAILURE"]
JOB_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)

# Points per schema.org type.
SCHEMA_TYPE_POINTS = {
    "Product": 5,
    "Organization": 5,
    "Article": 4,
    "BreadcrumbList": 4,
    "LocalBusiness": 4,
    "Person": 4,
    "WebPage": 3,
    "Event": 3,
    "Review": 3,
}

# Points per robots directive.
ROBOTS_POINTS = {
    "index": 10,
    "noindex": -10,
    "follow": 10,
    "nofollow": -10,
    "all": 20,
    "none": -20,
    "noarchive": -5,
    "nosnippet": -5,
}

# The 39 status codes that make a page unreachable, with our own short reasons.
UNREACHABLE_REASONS = {
    400: "bad request",
    401: "sign-in needed",
    403: "access denied",
    404: "page not found",
    405: "method not allowed",
    406: "no acceptable format",
    407: "proxy sign-in needed",
    408: "request timed out",
    409: "state conflict",
    410: "page removed",
    411: "length needed",
    412: "precondition failed",
    413: "payload too large",
    414: "address too long",
    415: "media type not supported",
    416: "range not available",
    417: "expectation failed",
    418: "request refused",
    421: "misdirected request",
    422: "content not processable",
    423: "resource locked",
    424: "dependency failed",
    425: "too early",
    426: "upgrade needed",
    428: "precondition needed",
    429: "too many requests",
    431: "header fields too large",
    451: "blocked for legal reasons",
    500: "server error",
    501: "not implemented",
    502: "bad gateway",
    503: "service unavailable",
    504: "gateway timed out",
    505: "protocol version not supported",
    506: "variant negotiation error",
    507: "storage exhausted",
    508: "loop detected",
    510: "extension needed",
    511: "network sign-in needed",
}

# Category weights of the page score, in summation order.
CATEGORY_WEIGHTS = [
    ("structured_data", 0.40),
    ("metadata", 0.25),
    ("content_quality", 0.20),
    ("connectivity", 0.10),
    ("technical_compliance", 0.05),
]
# Order in which a page's messages are counted for the site's top lists.
MESSAGE_ORDER = ["structured_data", "connectivity", "content_quality", "technical_compliance", "metadata"]

# Stable message codes and their wording. Codes ending in ':' take a number or a heading.
MESSAGES = {
    "title.missing": "There is no title tag",
    "title.empty": "The title carries no text",
    "title.short": "The title has fewer than five words",
    "title.good": "The title has a suitable length",
    "title.long": "The title has more than fifteen words",
    "title.add": "Add a title tag",
    "title.matters": "Titles are what answer engines quote first",
    "title.lengthen": "Use five words or more in the title",
    "title.describe": "Let the title say what the page is about",
    "title.shorten": "Cut the title to fifteen words or fewer",
    "description.missing": "There is no meta description",
    "description.empty": "The meta description carries no text",
    "description.short": "The meta description has fewer than fifteen words",
    "description.good": "The meta description has a suitable length",
    "description.long": "The meta description has more than twenty words",
    "description.add": "Add a meta description",
    "description.matters": "Descriptions help engines decide what to cite",
    "description.lengthen": "Use fifteen words or more in the description",
    "description.describe": "Let the description sum up the page",
    "description.shorten": "Cut the description to twenty words or fewer",
    "canonical.missing": "There is no canonical link",
    "canonical.present": "A canonical link is set",
    "canonical.add": "Set a canonical link so citations point at one address",
    "robots.blocked": "Robots directives shut crawlers out",
    "robots.restricted": "Robots directives hold crawlers back",
    "robots.default": "Robots directives are left at their default",
    "robots.mostly_open": "Robots directives are mostly open",
    "robots.open": "Robots directives are fully open",
    "robots.unblock": "Take out the blocking robots directives",
    "robots.review": "Review the restricting robots directives",
    "robots.state": "State index and follow explicitly",
    "length.short": "The body text is under 800 words",
    "length.good": "The body text has a suitable length",
    "length.long": "The body text is over 2500 words",
    "length.lengthen": "Write more body text",
    "length.detail": "Cover the topic in more detail",
    "length.focus": "Narrow the body text to its topic",
    "length.spam": "Very long pages can be taken for spam",
    "h1.single": "There is exactly one h1",
    "h1.several": "There is more than one h1",
    "h1.missing": "There is no h1",
    "h1.keep_one": "Keep one h1 per page",
    "h1.add": "Add an h1 that names the topic",
    "headings.enough": "There are enough headings",
    "headings.few": "There are only one or two headings",
    "headings.none": "There are no headings",
    "headings.add_more": "Split the text under more headings",
    "headings.add": "Add headings to give the page a structure",
    "hierarchy.good": "h1 and h2 form a hierarchy",
    "hierarchy.no_h2": "There is an h1 but no h2",
    "hierarchy.none": "There is no heading hierarchy",
    "hierarchy.add_h2": "Add h2 headings under the h1",
    "hierarchy.add": "Add an h1 and h2 headings",
    "heading_words.good": "Headings have a suitable length",
    "heading_words.brief": "Headings are very brief",
    "heading_words.off": "Some heading has no words or runs on for too many",
    "heading_words.lengthen": "Use five to ten words per heading",
    "heading_words.fix": "Keep headings between five and ten words",
    "body.empty": "There is no body text",
    "body.diverse": "The vocabulary is varied",
    "body.moderate": "The vocabulary is moderately varied",
    "body.repetitive": "The text repeats itself",
    "body.write": "Write body text for the page",
    "body.matters": "Pages without text are not cited",
    "body.vary": "Vary the wording and the topics",
    "body.rewrite": "Rewrite the text with more substance",
    "body.no_stuffing": "Do not repeat keywords",
    "schema.present": "There is JSON-LD markup",
    "schema.missing": "There is no JSON-LD markup",
    "schema.add": "Add JSON-LD markup",
    "types.none": "No known schema type is used",
    "types.basic": "A few known schema types are used",
    "types.good": "Several known schema types are used",
    "types.excellent": "Many known schema types are used",
    "types.add": "Use types such as Product, Organization or Article",
    "types.add_more": "Use more specific schema types",
    "faq.none": "There is no FAQ markup",
    "faq.add": "Add FAQ markup for common questions",
    "faq.limited": "There are five FAQ entries or fewer",
    "faq.good": "There is a good number of FAQ entries",
    "faq.many": "There are more than ten FAQ entries",
    "faq.add_more": "Add FAQ entries",
    "faq.reduce": "Keep FAQ entries to ten or fewer",
    "faq_answers.brief": "FAQ answers are under ten words",
    "faq_answers.good": "FAQ answers have a suitable length",
    "faq_answers.long": "FAQ answers are over fifty words",
    "faq_answers.expand": "Use ten words or more per answer",
    "faq_answers.shorten": "Keep answers to fifty words or fewer",
    "links.none": "There are no internal links",
    "links.few": "There are five internal links or fewer",
    "links.good": "There is a good number of internal links",
    "links.many": "There are more than twenty internal links",
    "links.add": "Link to other pages of the site",
    "links.add_more": "More of the other pages could be linked from here",
    "links.reduce": "Keep only the relevant internal links",
    "images.good": "No image is without an alternative text",
    "images.critical": "A great many images lack alt text",
    "images.missing:": "Images without alt text: ",
    "images.add": "Add alt text to the images",
    "images.urgent": "Add alt text soon, too many images lack it",
    "images.audit": "Go through all images and add alt text",
    "section.coherent:": "Section matches its heading: ",
    "section.drifts:": "Section drifts from its heading: ",
    "section.misaligned:": "Section does not match its heading: ",
    "section.refocus:": "Bring the section back to its heading: ",
    "section.rewrite": "Rewrite the section or rename its heading",
    "page.coherent": "Sections match their headings",
    "page.moderate": "Some sections drift from their headings",
    "page.poor": "Most sections do not match their headings",
    "page.review": "Review the sections with low scores",
    "page.overhaul": "Go through all headings and sections",
}
