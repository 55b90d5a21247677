"""Word lists, patterns and tables that results depend on."""

# Replies that carry no information, compared with the whole normalized key.
CONFIRM_KEYS = (
    "同意", "要的", "需要", "需要的", "没问题了", "可以了", "好了", "hi", "hello", "你好", "好", "好的", "好吧", "行", "行吧",
    "嗯", "嗯嗯", "对", "对的", "是", "是的", "可以", "可以的", "没问题", "继续", "ok", "okay", "yes", "y", "continue",
)
# Substrings that mark a correction.
CORRECTION_MARKERS = (
    "先别", "先不要", "不要", "别改", "只讨论", "不对", "不是", "停一下", "重新", "不需要", "不用", "不写", "别再",
    "never", "don't", "do not", "stop", "wait", "instead",
)
# Whole words that mark tooling and workflow.
TOOL_WORDS = ("gh", "git", "tea", "uv", "bun", "docker", "ssh", "npm", "pnpm", "pip", "playwright", "obscura", "pytest", "ruff", "pyright", "cargo", "brew", "make", "orb")
WORKFLOW_WORDS = ("commit", "push", "pull", "fix", "review", "plan", "release", "read", "update", "init", "save", "move")
# Substrings that mark workflow and preference.
WORKFLOW_MARKERS = (
    "提交", "推送", "执行", "开始", "实施", "修复", "审查", "方案", "计划", "发版", "发布", "合并", "清理", "整理", "创建", "新建",
    "检查", "修订", "修正", "更新", "阅读", "了解", "分析", "建议", "进度", "汇报", "下一步",
)
PREFERENCE_MARKERS = ("请用", "使用", "优先", "默认", "简体", "中文", "习惯", "统一", "保持", "prefer", "always")
# Where a candidate of a kind and confidence should go; others are observed.
DESTINATIONS = {
    ("constraint", "strong"): "AGENTS", ("constraint", "medium"): "notes",
    ("preference", "strong"): "AGENTS", ("preference", "medium"): "notes",
    ("tooling", "strong"): "AGENTS", ("tooling", "medium"): "notes",
    ("workflow", "strong"): "skill", ("workflow", "medium"): "prompt",
}
# Review sections, conclusion kinds and destinations, in order.
SECTIONS = ("constraint", "preference", "tooling", "workflow", "other", "medium", "template")
CONCLUSION_KINDS = ("constraint", "preference", "tooling", "workflow", "style")
CONCLUSION_DESTS = ("AGENTS", "skill", "prompt", "notes")
# Placeholders.
PATH_TOKEN, NUMBER_TOKEN = "§p", "§n"
PATH_SHOWN, NUMBER_SHOWN = "‹路径›", "‹数字›"
# Thresholds.
FUZZY_CHARS, FUZZY_JACCARD = (4, 200), 0.85
COSINE_TFIDF, COSINE_EMBEDDING = 0.55, 0.8
TFIDF_CHARS, TFIDF_GRAMS = 300, (2, 4)
LONG_LIVED_DAYS, LONG_LIVED_FACTOR, TEMPLATE_CHARS = 90, 3, 200
LABEL_CHARS, VARIANT_CHARS, VARIANTS_SHOWN, ITEMS_SHOWN, PROJECTS_SHOWN = 60, 40, 5, 8, 10
