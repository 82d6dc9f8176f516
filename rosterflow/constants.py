"""Names, codes, limits and texts that results must carry verbatim."""

# --- change data capture -------------------------------------------------
# Operations of a row change.
OP_INSERT, OP_UPDATE, OP_DELETE, OP_SNAPSHOT = "INSERT", "UPDATE", "DELETE", "SNAPSHOT"
CDC_OPERATIONS = [OP_INSERT, OP_UPDATE, OP_DELETE, OP_SNAPSHOT]

# Outcomes of handling one change event.
SUCCESS = "SUCCESS"
SKIPPED_DUPLICATE = "SKIPPED_DUPLICATE"
RETRY_EXHAUSTED = "RETRY_EXHAUSTED"
MAPPING_MISSING = "MAPPING_MISSING"
DEAD_LETTER = "DEAD_LETTER"
RETRY = "RETRY"

# Target systems by source-table prefix; everything else goes to the default.
SINK_BY_TABLE_PREFIX = {"dorm_": "dorm-system", "card_": "card-system"}
DEFAULT_SINK = "edu-system"

# Latency monitoring.
LATENCY_WINDOW = 1000
P95_TARGET_MS = 5000

# --- domain events -------------------------------------------------------
# Event types.
CHECKIN_SUCCESS = "student.checkin.success"
PAYMENT_COMPLETED = "student.payment.completed"
VERIFIED_SUCCESS = "student.verified.success"
CHECKIN_COMPLETED = "student.checkin.completed"
EVENT_TYPES = [CHECKIN_SUCCESS, PAYMENT_COMPLETED, VERIFIED_SUCCESS, CHECKIN_COMPLETED]

# Event type -> queue bindings.
BINDINGS = [
    (CHECKIN_SUCCESS, "q.dorm.checkin"),
    (CHECKIN_SUCCESS, "q.card.issue"),
    (CHECKIN_SUCCESS, "q.parent.notify"),
    (CHECKIN_SUCCESS, "q.parent.notify.push"),
    (PAYMENT_COMPLETED, "q.dorm.allocate"),
    (PAYMENT_COMPLETED, "q.flow.complete"),
    (VERIFIED_SUCCESS, "q.card.issue"),
    (VERIFIED_SUCCESS, "q.edu.activate"),
    (CHECKIN_COMPLETED, "q.edu.register"),
]

# Limits of queues and retries.
MAX_RETRY_COUNT = 3
RETRY_DELAYS_SECONDS = [10, 30, 60]
MESSAGE_TTL_HOURS = 24
QUEUE_MAX_LENGTH = 10_000
IDEMPOTENT_HOURS = 24
# Exchanges and headers of messages that are sent again or given up.
RETRY_EXCHANGE, DEAD_LETTER_EXCHANGE = "student.events.retry", "student.events.dlx"
HEADER_RETRY_COUNT, HEADER_QUEUE = "x-retry-count", "x-original-queue"
HEADER_ROUTING_KEY, HEADER_REASON = "x-original-routing-key", "x-dead-letter-reason"
# Fixed value: text of a notice.
NOTIFICATION_TEXT = "您的孩子已到校，请放心。"

# Check-in steps (code, display name, event type that completes it).
PROGRESS_STEPS = [
    ("checkin_success", "签到到校", CHECKIN_SUCCESS),
    ("payment_completed", "缴费确认", PAYMENT_COMPLETED),
    ("verified_success", "资格核验", VERIFIED_SUCCESS),
    ("checkin_completed", "报到完成", CHECKIN_COMPLETED),
]
# Arrival states as shown.
ARRIVAL_DISPLAY = {"not_arrived": "未到校", "arrived": "已到校", "completed": "报到完成"}

# --- retrieval and answers -----------------------------------------------
# Categories of knowledge, weights and limits of retrieval.
CATEGORIES = ["PROCESS", "POI", "FAQ", "MATERIAL"]
BM25_K1, BM25_B = 1.5, 0.75
VECTOR_WEIGHT, BM25_WEIGHT = 0.7, 0.3
TOP_K = 5
LOW_CONFIDENCE_THRESHOLD = 0.6
FAQ_MIN_SCORE = 0.5
SNIPPET_MAX = 120
MAX_REPLY_LENGTH = 500
HISTORY_ROUNDS = 5
MESSAGE_MAX_LENGTH = 500

# Reply texts.
LOW_CONFIDENCE_REPLY = "抱歉,未检索到足够相关的信息。建议咨询现场志愿者或辅导员。"
NO_SOURCE_REPLY = "抱歉,未检索到相关信息。建议咨询现场志愿者或辅导员。"
FAQ_FALLBACK_REPLY = "抱歉,当前为离线降级模式,未能匹配到您的问题。建议咨询现场志愿者或辅导员,或稍后重试。"
MORE_SOURCES_HEADING = "\n\n补充信息:"

# The instruction block that opens every prompt.
SYSTEM_PROMPT = (
    "你是大学迎新智能助手,仅基于下方检索到的知识库内容回答新生问题。\n"
    "规则:\n"
    "1. 仅使用检索上下文中的信息作答,禁止臆造库外事实。\n"
    "2. 超出知识库覆盖范围时,明确回复\"建议咨询现场志愿者或辅导员\"。\n"
    "3. 涉及流程环节跳转时,在回复末尾输出 [[STEP:环节标识]] 标记(如 [[STEP:payment]])。\n"
    "4. 涉及校园地点导航时,在回复末尾输出 [[POI:地点名称]] 标记(如 [[POI:第一食堂]])。\n"
    "5. 回复简洁明了,控制在 300 字以内。\n"
)
# Headings of a prompt.
PROMPT_CONTEXT_HEADING = "\n【检索上下文】\n"
PROMPT_NO_SOURCES = "(无相关检索结果)\n"
PROMPT_CURRENT_HEADING = "【当前上下文】"
PROMPT_STEP = "环节="
PROMPT_IDENTITY = ", 身份="
PROMPT_HISTORY_HEADING = "\n【历史对话】\n"
PROMPT_QUESTION_HEADING = "\n【当前问题】\n"

# Content labels (type, text, degraded, mode).
LABEL_NORMAL = ("ai_content", "本内容由 AI 生成,仅供参考", False, None)
LABEL_FAQ = ("faq_mode", "当前为离线降级模式,回复来自 FAQ 匹配", True, "faq_keyword")

# Safety rules in order of precedence (category, patterns, refusal text).
SAFETY_RULES = [
    (
        "self_harm",
        ["自杀|自残|轻生|不想活|了结自己|割腕|跳楼", "活不下去|想死|结束生命"],
        "如果您正在经历困难,请立即联系辅导员或拨打心理援助热线 400-161-9995。"
        "校园心理咨询中心位于学生活动中心 3 楼,预约电话 010-xxxx。",
    ),
    (
        "prompt_injection",
        [
            r"(?i)ignore\s+(previous|above|all)\s+(instructions?|prompts?)",
            "忽略(以上|之前|前面|所有)(指令|提示|规则|约束)",
            r"(?i)you\s+are\s+now\s+",
            "你现在是",
            r"(?i)^\s*system\s*:",
            r"(?i)DAN\s+mode|developer\s+mode|jailbreak",
        ],
        "检测到疑似提示词注入,请求已被拦截。我仅能回答迎新相关问题。",
    ),
    (
        "privacy_query",
        [
            "查一下.{0,6}(学号|信息|成绩|宿舍)",
            r"查(某人|同学|学号\d+).{0,6}(信息|电话|地址)",
            "(告诉我|给我).{0,6}(某某|某学号).{0,6}(电话|地址|身份证)",
        ],
        "抱歉,我无法查询他人个人信息。如需办理相关业务,请前往行政楼一楼核验窗口咨询。",
    ),
    (
        "overstep_request",
        [
            "(帮我|替我|给我).{0,6}(修改|更改|删除|取消).{0,6}(缴费|状态|成绩|报到|记录)",
            "(修改|更改|删除|取消).{0,6}(缴费状态|报到记录|成绩)",
        ],
        "抱歉,系统状态修改需现场办理。请前往对应环节窗口由工作人员处理。",
    ),
    (
        "political_sensitive",
        ["政治|国家领导|政权|颠覆", "反动|叛乱|政变"],
        "抱歉,该问题超出我能解答的范围,建议您咨询现场志愿者或辅导员。",
    ),
]

# Intent rules in order (question words, section words, title words, marker).
# A marker of None stands for a place marker built from the section itself.
INTENT_RULES = [
    (["缴费", "学费"], ["缴纳"], [], "[[STEP:payment]]"),
    (["宿舍", "入住"], ["宿舍"], [], "[[STEP:dorm_assign]]"),
    (["材料", "提交"], ["材料"], [], "[[STEP:material_upload]]"),
    (["核验", "身份"], ["核验"], [], "[[STEP:verification]]"),
    (["体检"], ["体检"], [], "[[STEP:checkin]]"),
    (["在哪", "怎么走", "位置"], ["食堂", "图书馆", "医院"], ["POI"], None),
]

# Tool catalogue, navigation steps and points of interest.
TOOL_STEP, TOOL_NAVIGATION = "navigate_to_step", "start_navigation"
STEP_CATALOGUE = [
    ("verification", "身份核验", "/pages/checkin/verify/index"),
    ("payment", "缴纳学费", "/pages/checkin/pay/index"),
    ("dorm_assign", "宿舍入住", "/pages/checkin/dorm/index"),
    ("checkin", "入学体检", "/pages/checkin/health/index"),
    ("material_upload", "材料提交", "/pages/checkin/material/index"),
]
POI_CATALOGUE = [
    ("canteen_1", "第一食堂", "食堂", 320),
    ("canteen_2", "第二食堂", "食堂", 580),
    ("canteen_halal", "清真食堂", "食堂", 450),
    ("library_main", "中心图书馆", "图书馆", 300),
    ("hospital", "校医院", "医院", 600),
]
# Link and text of a navigation.
NAV_URL_PREFIX = "/pages/map/nav?dest="
TOOL_DISPLAY_PREFIX = "跳转至 "

# --- limits and access ---------------------------------------------------
# Limits a minute.
CHAT_LIMIT_PER_MINUTE = 10
TOOL_LIMIT_PER_MINUTE = 10
# Rate rules by path prefix in order (prefix, bucket size, refill per minute).
RATE_RULES = [("/api/v1/ai", 10, 10), ("/api/v1/parent/bind", 5, 5)]
# Limits of code requests and lockouts.
CODE_REQUEST_WINDOW_SECONDS, CODE_REQUEST_MAX = 60, 1
MAX_ERROR_COUNT, LOCK_SECONDS = 5, 1800

# Result codes of the binding flow.
CODE_OK = 0
CODE_NOT_REGISTERED = 40003
CODE_WRONG = 40004
CODE_LOCKED = 40005
CODE_RATE_LIMITED = 90004

# --- privacy -------------------------------------------------------------
# JSON field name -> kind of personal data.
PII_FIELDS = {
    "idCard": "ID_CARD",
    "id_card": "ID_CARD",
    "identityNumber": "ID_CARD",
    "idNumber": "ID_CARD",
    "phone": "PHONE",
    "mobile": "PHONE",
    "phoneNumber": "PHONE",
    "mobileNumber": "PHONE",
    "name": "NAME",
    "studentName": "NAME",
    "parentName": "NAME",
    "fullName": "NAME",
    "email": "EMAIL",
    "address": "ADDRESS",
    "homeAddress": "ADDRESS",
    "familyAddress": "ADDRESS",
    "bankCard": "BANK_CARD",
    "bankCardNumber": "BANK_CARD",
}
# Endings of district names, and claims a token must not hold.
DISTRICT_SUFFIXES = ["区", "县", "市", "旗", "自治县", "自治旗"]
FORBIDDEN_CLAIMS = ["phone", "id_card", "idCard", "name", "address", "password"]
