"""Patterns, vocabularies, thresholds and sizes.  Every operator takes a Config and defaults to CONFIG."""

from __future__ import annotations

from dataclasses import dataclass, field

# Characters, markers and patterns that results depend on.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
DASHES = "[‐‑‒–—―−﹣－]+"
BLANKS = "[\\s\\p{Z}]+"
#: The characters of BLANKS.
BLANK_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The spaces among them, which SQL trims.
SPACE_CHARACTERS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Letters and numbers of Unicode 14 to 15.1, which patterns on the JVM may not know yet.
NEWER_WORDS = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 "
    "10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 "
    "107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 "
    "12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 "
    "1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee "
    "1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af "
)
NON_WORD = "[^\\p{L}\\p{N}_" + "".join("-".join(f"\\x{{{c}}}" for c in r.split("-")) for r in NEWER_WORDS.split()) + "]+"
PUNCTUATION_FROM = "，。：；！？（）【】｛｝“”‘’、．－—–／＼｜"
PUNCTUATION_TO = ",.:;!?()[]{}\"\"'',.---/\\|"
TITLE_NUMBER = "^\\s*(?:\\(?\\d+\\)?\\s*[.、,:：;；)）-]|第\\s*\\d+\\s*[章节篇]\\s*)\\s*"
LEADING_NUMBER = "^\\s*(?:第\\s*[一二三四五六七八九十百\\d]+\\s*[章节篇]|[一二三四五六七八九十百\\d]+[、.．)）]|[（(][一二三四五六七八九十百\\d]+[）)])\\s*"
DISPLAY_NUMBER = "^(?:\\s*(?:第\\s*[一二三四五六七八九十百\\d]+\\s*[章节篇]|[一二三四五六七八九十百\\d]+[、.．)）]|[（(][一二三四五六七八九十百\\d]+[）)]))+\\s*"
HEADING_NUMBERS = "第[一二三四五六七八九十百\\d]+[章节篇]|(?:^|\\s)[一二三四五六七八九十百]+[、.]|[（(][一二三四五六七八九十百\\d]+[）)]"
READABLE = "[A-Za-z0-9\u4e00-\u9fff]"
TERM = "[A-Za-z0-9]+|[\u4e00-\u9fff]"
NOISE_MARKERS = ("严禁复制", "复制此链接", "mininunversity", "hinannvvesiy", "qkc:/", "http://", "https://")
LINK_NOISE = "(?i)qkc:/|https?://|复制此链接"
SECRET = "(?i)(?:sk-[A-Za-z0-9_-]{8,}|(?:password|secret|token|api[_ -]?key)\\s*[:=]\\s*\\S+)"
SECRET_MASK = "[敏感信息已隐藏]"
UNSAFE_FILENAME = "[<>:\"/\\\\|?*：／＼\\x00-\\x1f]+"
EXAM_MARKERS = ("需掌握", "重点掌握", "核心考点", "了解", "理解为主", "无需死记硬背", "需在", "需区分", "不能将", "考试说明", "作答要求", "背诵要求")
TASK = "案例|论述|应用|作答|分析题|结合.+模型|答题|^相关计算|^计算题"
COLLECTION_QUERY = "^(?:各|经典|主要|核心).*(?:考点|理论|方法|模型)$|等(?:基础|主要|常见)?(?:方法|内容|理论)$"
COLLECTION_RECORD = "(?:特征|特点|类型|原则|步骤|流程|因素|模块|构成|内容|方法)(?:是|为|包括|包含|如下|[：:]?\\s*$)"
COLLECTION_OUTLINE = "(?:特征|特点|类型|原则|步骤|流程|因素|模块|构成|内容|方法)(?:是|为|包括|包含|如下|[：:]?\\s*)$|^(?:各|经典|主要|核心).*(?:考点|理论|方法|模型)$"
INSTRUCTION = "^(?:需|应|能够|要求)?(?:重点)?掌握|理解即可|了解即可|无需.*|不能.*|注意.*|是核心考点|整体难度.*|对应课堂.*|^二者的?(?:核心)?区别|^各自的?(?:范畴|内容|内涵)"
CONNECTORS = "[、,，;；/]|(?<=[\u4e00-\u9fffA-Za-z0-9])(?:以及|及|与|和)(?=[\u4e00-\u9fffA-Za-z0-9])"
COMPARISON = "(?:的)?(?:联系与区别|区别与联系|区别|差异|异同|比较)$"
SHARED_SUFFIXES = "性型式类期侧方部"
RELATED, RELATED_MODEL = "理论|模型|方法|原理", "理论|模型|原理"
USEFUL_DETAIL = "定义|内涵|原理|步骤|流程|因素|例如|例子|案例|计算|公式|方法"
CHAPTER_LINE = "^\\s*第[一二三四五六七八九十百零〇0-9]+章(?:\\s+|[：:、.-])?.+\\s*$"
SECTION_LINE = "^\\s*(?:第[一二三四五六七八九十百零〇0-9]+节|\\d+(?:\\.\\d+)+)(?:\\s+|[：:、.-])?.+\\s*$"
TOC_LINE = "^\\s*第\\s*[一二三四五六七八九十百零〇\\d]+\\s*章(?:\\s+|[：:、.．\\-—–])?.+"
NUMBERED_CHAPTER = "^第\\s*([一二三四五六七八九十百零〇\\d]+)\\s*章"
OUTLINE_CHAPTER = "^第\\s*[一二三四五六七八九十百千万零〇两\\d]+\\s*章(?:\\s+|[：:、.-]*)(.+)?$"
OUTLINE_NUMBER = "^(?:\\d+(?:\\.\\d+)*(?:[.、．:：)）]\\s*|\\s+)|[（(]\\s*(?:\\d+(?:\\.\\d+)*|[一二三四五六七八九十]+)\\s*[）)]\\s*|[一二三四五六七八九十]+[.、．:：]\\s*)"
OUTLINE_TRIM = "•·●○▪▫◆◇—–-_=~*#|/\\"
HIDDEN_TITLES = ("未分章", "未归类内容", "未分类", "未分类内容", "其他", "其它", "题纲父标题", "提纲父标题", "大纲父标题", "目录", "课程目录", "contents")
PAGE_RANGE = "(?i)(?:^|[·•|｜])?\\s*第?\\s*\\d+\\s*(?:[-~至]\\s*\\d+\\s*)?页\\s*$"
FILE_PAGES = "(?i)\\.(?:pdf|docx?|pptx?|txt)\\s*(?:[·•|｜-]\\s*)?第?\\s*\\d+"
TOC_TAIL = "\\s*[/／]\\s*\\d+\\s*$"
BARE_CHAPTER = "^第\\s*[一二三四五六七八九十百零〇\\d]+\\s*(?:章|章节|节|篇)$"
ONLY_NUMBERING = "^[一二三四五六七八九十百零〇\\d\\s.、()（）-]+$"
SHORT_NUMBERING = "^(?:第?[一二三四五六七八九十百\\d]+[章节篇部、.]?)+"
ORDERED_LINE = "^\\s*(?:\\d+[.、)）]|[（(][一二三四五六七八九十\\d]+[）)])\\s*(.+)$"
UNORDERED_LINE = "^\\s*[-•·]\\s*(.+)$"
KEYWORD_SPLIT, KEYWORD_ITEMS, PARAGRAPHS = "[\\n、，,；;]+", "[\\n、，,；;|/]+", "\\n\\s*\\n+"

# Weights and bounds of the match score and of the choice of evidence.
TITLE_SCORE, TITLE_PART_SCORE, BODY_SCORE, SEQUENCE_FACTOR, GRAM_FACTOR = 1.0, 0.92, 0.8, 0.72, 0.68
CHAPTER_BONUS, STRUCTURAL_FACTOR, LINK_FACTOR, FACTORS_BELOW = 0.08, 0.55, 0.75, 0.9
SCORE_GATE, GRAM_GATE, STRICT_LENGTH, HEAD_FACTOR, HEAD_LENGTH = 0.8, 0.6, 4, 6, 160
STRUCTURAL_LENGTH, UNNUMBERED_LENGTH, CONTENTS_WORD = 50, 16, "目录"
PASSAGE_LENGTH, LONG_BONUS, SHORT_MALUS, DETAIL_BONUS = 50, 0.05, -0.08, 0.06
NEW_PAGES_BONUS, SHARED_PAGES_MALUS, COVER_BONUS = 0.08, -0.12, 0.14
DUPLICATE, DUPLICATE_ON_SHARED_PAGES, MOST_PAGES = 0.9, 0.65, 0.8

# Vocabularies.
KEYWORDS = {
    "人口人力人才的关系": ("人口资源", "人力资源", "人才资源"),
    "人口人力人才关系": ("人口资源", "人力资源", "人才资源"),
    "人力资源的五大特征": ("能动性", "可再生性", "增值性", "时效性", "社会性"),
    "人力资源管理的核心内容": ("人力资源规划", "招聘", "培训", "绩效", "薪酬", "员工关系"),
    "人力资本": ("舒尔茨", "贝克尔", "知识技能", "能力资本"),
}
ALIAS_GROUPS = (
    ("赫茨伯格双因素理论", "双因素理论", "激励-保健理论", "激励保健理论", "保健因素", "激励因素"),
    ("X-Y理论", "X理论与Y理论", "X理论", "Y理论", "麦格雷戈理论", "麦格雷戈X理论与Y理论"),
    ("工作说明书", "职位说明书", "岗位说明书", "职务说明书"),
    ("招募", "招聘", "人员招募"),
    ("甄选", "选拔", "人员甄选"),
    ("录用", "人员录用"),
    ("问卷法", "问卷调查法", "职位分析问卷法"),
    ("德尔菲法", "专家预测法", "专家意见法"),
    ("经验判断法", "管理人员判断法", "主观判断法"),
    ("内部人力资源供给预测", "内部供给预测", "内部供给"),
    ("外部人力资源供给预测", "外部供给预测", "外部供给"),
    ("人力资源供给总量", "总供给", "供需平衡"),
    ("人力资源管理发展历程", "人力资源管理发展阶段", "人事管理发展", "行业发展简史"),
    ("6W1H", "六何分析法", "六何分析"),
)
EXPANSIONS = (
    (("内部供给", "外部供给", "总供给"), ("内部人力资源供给预测", "外部人力资源供给预测", "人力资源供给总量 供需平衡计算")),
    (("德尔菲", "经验判断"), ("德尔菲法 专家预测法", "经验判断法 主观判断法")),
    (("工作说明书", "6w1h"), ("工作说明书 职位说明书 岗位说明书", "6W1H 六何分析")),
    (("招募", "甄选", "人员配置"), ("员工招募 招聘", "员工甄选 选拔", "人员配置 录用 人岗匹配")),
    (("转化率", "录用率", "招聘成本"), ("招聘转化率", "人员录用率", "招聘成本效用 招聘评估")),
    (("问卷法", "基础方法"), ("问卷调查法", "访谈法", "观察法", "工作日志法", "关键事件法")),
    (("各模块", "核心考点"), ("人力资源规划", "员工招聘 招募甄选", "员工培训 培训开发", "绩效管理", "薪酬管理", "员工关系 劳动关系")),
    (("经典", "核心理论"), ("泰勒科学管理理论", "马斯洛需求层次理论", "麦格雷戈X理论与Y理论", "赫茨伯格双因素理论")),
    (("行业发展简史",), ("人力资源管理发展历程 人事管理 科学管理 人际关系运动 战略性人力资源管理",)),
)


@dataclass(frozen=True)
class Config:
    chapter_line: str = CHAPTER_LINE
    section_line: str = SECTION_LINE
    alias_groups: tuple = ALIAS_GROUPS
    expansions: tuple = EXPANSIONS
    keywords: dict = field(default_factory=lambda: dict(KEYWORDS))
    threshold: float = 0.35
    fallback: float = 0.28
    candidates: int = 6
    evidence: int = 4
    evidence_characters: int = 12_000
    target_size: int = 1800
    maximum_size: int = 2600
    stale_seconds: int = 1200
    workspace_pages: int = 1200
    total_pages: int = 3000
    ocr_least: int = 32
    #: Bytes up to which a vocabulary or plan table is sent to all executors.
    broadcast_bytes: int = 32 << 20
    #: Share of all pairs up to which the similarity join goes by rare grams.
    few_pairs: float = 0.1


CONFIG = Config()
