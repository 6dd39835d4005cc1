"""Lexicons, patterns and messages.

FIXED VALUES: every list and string below must equal the behaviour we
reproduce (spam words, blocklist, probe patterns, routing rules and
keywords, response policies, bot user agents, class order, messages).
They are stated as plain text, in their natural order, and are data: the
operators turn them into column expressions or small broadcast tables.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Corpus cleaning: spam / junk keywords, checked case-insensitively in order.
SPAM_KEYWORDS = [
    "pinmuch", "品品品", "网购返利",
    "获取本书PDF全文", "请前往", "搜索该书名",
    "欢速药夯患PDF", "全文，请前往",
    "http://", "https://", "www.",
    "精品资源", "扫码关注", "微信公众号", "公众号",
    '尽在""', "献给", "专业关爱",
    "版权所有", "保留所有权利",
    "流产康复", "做个爱她的男人", "做个体己的女子",
]
MIN_USEFUL_LENGTH = 50

# Question validation.
MAX_INPUT_LENGTH = 100
BLOCKED_KEYWORDS = [
    "系统提示词", "system prompt", "system_prompt",
    "模型", "model", "模型信息", "model info", "model_info",
    "知识库", "knowledge base", "knowledge_base",
    "向量库", "vector store", "vector_store",
    "embedding", "嵌入", "embeddings",
    "检索", "retrieval", "retrieve",
    "文档", "documents", "docs",
    "原始数据", "raw data", "source",
    "提示词", "prompt", "template",
    "配置", "config", "configuration",
    "什么模型", "which model", "什么技术", "what technology",
]
SYSTEM_PROBE_PATTERNS = [
    r"你的.*提示词|your.*prompt",
    r"系统.*配置|system.*config",
    r"模型.*信息|model.*info",
    r"知识库.*内容|knowledge.*content",
    r"原始.*文档|raw.*document",
    r"向量.*数据|vector.*data",
    r"检索.*过程|retrieval.*process",
    r"embedding.*模型|嵌入.*模型",
]
# "api" is listed twice on purpose: one "api" already counts as two terms.
TECH_TERMS = ["api", "endpoint", "database", "server", "backend", "frontend",
              "api", "接口", "数据库", "服务器", "后端", "前端"]
TECH_TERMS_LIMIT = 3
MSG_EMPTY = "输入内容不能为空"
MSG_TOO_LONG = "输入内容过长，最大允许 {max} 字符，当前 {n} 字符"
MSG_SECURITY = "抱歉，我无法回答关于系统技术细节的问题。请问您有什么其他需要帮助的吗？"

# Intent routing (shipped configuration).
INTENT_RULES = {
    "greeting": [
        r"^(你好|您好|hi|hello|hey|早上好|下午好|晚上好|嗨)[！!。.～~]*$",
        r"^(在吗|在不在|有人吗)[？?]*$",
    ],
    "politeness": [
        r"^(谢谢|感谢|多谢|thanks|thank you)[！!。.～~]*$",
        r"^(再见|拜拜|bye|goodbye|see you)[！!。.～~]*$",
        r"^(不用了|不需要|没事)[。.！!]*$",
    ],
    "system": [
        r".*(系统提示|提示词|prompt|system prompt).*",
        r".*(模型|model|技术栈|技术细节|architecture).*",
        r".*(知识库|向量库|数据库|database).*",
        r".*(你是.*模型|什么模型|which model|哪个模型).*",
    ],
    "unknown": [
        r"^(嗯|啊|哦|呃|额|这个|那个|嘛)[。.！!？?～~]*$",
        r"^[？?]+$",
        r"^[。.！!]+$",
    ],
}
INTENT_KEYWORDS = {
    "greeting": [
        "你好", "您好", "hi", "hello", "hey", "早上好", "下午好", "晚上好",
        "在吗", "在不在", "有人吗", "嗨",
    ],
    "politeness": [
        "谢谢", "感谢", "多谢", "thanks", "thank you",
        "再见", "拜拜", "bye", "goodbye", "see you",
        "不用了", "不需要", "没事",
    ],
    "system": [
        "系统提示", "提示词", "prompt", "system prompt",
        "模型", "model", "技术栈", "技术细节", "architecture",
        "知识库", "向量库", "数据库", "database",
        "什么模型", "哪个模型", "which model",
    ],
    "unknown": [
        "嗯", "啊", "哦", "呃", "额", "这个", "那个", "嘛",
    ],
}
# The wider lists that serve where no configuration is given (profile "extended").
EXTENDED_INTENT_RULES = {
    "greeting": [
        r"^(你好|您好|hi|hello|hey|早上好|下午好|晚上好|嗨)[！!。.～~]*$",
        r"^(在吗|在不在|有人吗)[？?]*$",
        r"^(你是谁|你是什么|你叫什么|你叫什么名字)[？?]*$",
        r"^(你能做什么|你可以做什么|你有什么功能|你能帮我做什么)[？?]*$",
        r"^(介绍一下你自己|自我介绍|你是干什么的|你是做什么的)[？?]*$",
        r"^(who are you|what are you|what can you do|introduce yourself)[？?]*$",
    ],
    "politeness": INTENT_RULES["politeness"],
    "system": INTENT_RULES["system"],
    "chitchat": [
        r"^(现在|几点|什么时间|今天|明天|星期|天气).*[？?]?$",
        r".*(几点了|什么时间|今天星期几|今天几号|现在是几号).*",
        r".*(天气|weather|温度|下雨|晴天).*",
        r".*(讲个笑话|唱首歌|背首诗|猜个谜语|陪我聊天).*",
        r".*(无聊|好无聊|闲着|没事做).*",
        r".*(算.*题|翻译|用.*语怎么说).*",
    ],
    "unknown": INTENT_RULES["unknown"],
}
EXTENDED_INTENT_KEYWORDS = {
    "greeting": [
        "你好", "您好", "hi", "hello", "hey", "早上好", "下午好", "晚上好",
        "在吗", "在不在", "有人吗", "嗨",
        "你是谁", "你是什么", "你叫什么", "你叫什么名字",
        "你能做什么", "你可以做什么", "你有什么功能", "你能帮我做什么",
        "介绍一下你自己", "自我介绍", "你是干什么的", "你是做什么的",
        "who are you", "what are you", "what can you do", "introduce yourself",
    ],
    "politeness": INTENT_KEYWORDS["politeness"],
    "system": [
        "系统提示", "提示词", "prompt", "system prompt",
        "模型", "model", "技术栈", "技术细节", "architecture",
        "知识库", "向量库", "数据库", "database",
        "什么模型", "哪个模型", "which model",
    ],
    "chitchat": [
        "现在几点", "几点了", "什么时间", "现在是几号", "今天星期几", "今天几号",
        "天气怎么样", "今天天气", "明天天气", "weather",
        "讲个笑话", "唱首歌", "背首诗", "猜个谜语", "陪我聊天",
        "无聊", "好无聊", "闲着", "没事做",
        "算一道题", "翻译", "用英语怎么说",
    ],
    "unknown": INTENT_KEYWORDS["unknown"],
}
# (intent, skip_rag, response); "knowledge" is the default policy.
INTENT_POLICIES = [
    ("greeting", True, "你好！我是智能问答助手，有什么可以帮助您的吗？"),
    ("politeness", True, "不客气！如有其他问题，随时提问。"),
    ("system", True, "抱歉，我无法回答关于系统技术细节的问题。请询问知识库相关的内容。"),
    ("chitchat", True, "抱歉，我是专业的知识问答助手，暂时无法回答时间、天气等闲聊问题。请询问知识库相关的内容。"),
    ("knowledge", False, None),
    ("unknown", True, "抱歉，我还不能理解您的问题，请补充完善您的提问。"),
]
RULE_CONFIDENCE = 1.0
KEYWORD_CONFIDENCE = 0.9
DEFAULT_CONFIDENCE = 0.5
ML_MIN_CONFIDENCE = 0.7
# Class order of the trainable intent model.
INTENT_CLASSES = ["greeting", "knowledge", "politeness", "system", "chitchat", "unknown"]

# Request screening.
SUSPICIOUS_USER_AGENTS = [
    "bot", "crawler", "spider", "scraper", "curl", "wget",
    "python-requests", "python-urllib", "java", "go-http-client",
    "postman", "insomnia", "httpie",
]
WHITELISTED_USER_AGENTS = ["googlebot", "bingbot", "baiduspider"]
BOT_REASON_EMPTY_UA = "缺少User-Agent"
BOT_REASON_SUSPICIOUS_UA = "可疑的User-Agent"
BOT_REASON_NO_REFERER = "缺少Referer"
MAX_CONCURRENT_REQUESTS = 4

# Retrieval and compression defaults.
RETRIEVER_K = 2
RETRIEVER_FETCH_K = 20
MMR_LAMBDA = 0.5
SCORE_THRESHOLD = 0.5
CHUNK_SIZE = 800
CHUNK_OVERLAP = 150
MAX_SENTENCES_PER_DOC = 3
MIN_SENTENCE_LENGTH = 5
PREFILTER_SENTENCES = 10
SENTENCE_TERMINATORS_CJK = "[。！？\n]+"
# Punctuation removed before n-gram keyword extraction.
NGRAM_STRIP_CLASS = "[，。！？、；：\"\"（）【】《》 \t\n\r]+"
QUERY_MAX_LENGTH = 50
QUERY_EXPANSION_TEMPLATE = "将用户问题改写为3-5个中文关键词，用空格或逗号分隔。\n\n用户问题：{question}\n\n检索关键词（只输出中文关键词，不要序号、不要解释、不要英文）："

# Retrieval-quality grades, best first, with their lower score bounds.
QUALITY_GRADES = [
    (80, "优秀 ⭐⭐⭐⭐⭐"),
    (60, "良好 ⭐⭐⭐⭐"),
    (40, "一般 ⭐⭐⭐"),
    (20, "较差 ⭐⭐"),
    (0, "很差 ⭐"),
]
SUGGEST_LOW_MAX = "⚠️ 最高相似度过低 - 建议重建向量库或优化文档分块"
SUGGEST_LOW_AVG = "⚠️ 平均相似度过低 - 检索质量差，建议优化数据质量"
SUGGEST_MISSED = "❌ 关键词未命中: {kws} - 检查文档是否包含相关内容"
SUGGEST_LOW_RANK = "⚠️ 关键词排名靠后: {kws} - 考虑减小CHUNK_SIZE"
SUGGEST_GOOD = "✅ 向量库质量良好，可以使用当前配置"
SUGGEST_FINE = "✅ 数据质量优秀，无需优化"

# Prompt assembly.
SYSTEM_PROMPT = "你是专业的宠物狗知识助手。请根据提供的参考资料回答用户问题。要求：用中文回答，基于参考资料，简洁明了（150字以内），不编造信息。"
USER_QUESTION_TEMPLATE = "参考资料：\n{context}\n\n问题：{question}\n\n请根据以上参考资料回答问题："
# ------------------------------------------------------------ END FIXED VALUES


def rule_rows():
    """Routing rules as rows (intent, intent_ord, pattern, pattern_ord)."""
    return [(intent, i, p, j)
            for i, (intent, pats) in enumerate(INTENT_RULES.items())
            for j, p in enumerate(pats)]


def keyword_rows():
    """Routing keywords as rows (intent, intent_ord, keyword, keyword_ord)."""
    return [(intent, i, k, j)
            for i, (intent, kws) in enumerate(INTENT_KEYWORDS.items())
            for j, k in enumerate(kws)]
