"""Word lists and small models' training data. All of them are defaults: a Lexicon with others is a parameter of every operator."""

from __future__ import annotations

import hashlib
import pkgutil
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from functools import cache, cached_property

# ---------------------------------------------------------------------------------------------------------------------
# Results are defined by these lists.

STOP_ZH = """的 了 着 过 地 得 吗 呢 吧 啊 呀 哦 嗯 哈 是 在 有 和 与 或 及 以及 并 而 而且 并且 或者 但是 但 因为 所以 如果 虽然 然而 于是 因此
把 被 让 给 对 从 到 向 为 为了 关于 通过 根据 按照 对于 由于 除了 就 才 都 也 还 又 再 只 很 更 最 非常 特别 太 不 没 没有 无 非 别
这 那 这个 那个 这些 那些 什么 怎么 为什么 如何 自己 大家 人们 有人 谁 哪里 这里 那里 一些 很多 所有 每 各 之 其 该 某 其他 其中
一个 一种 可以 可能 应该 需要 进行 表示 认为 知道 觉得 开始 结束 完成 等等 等"""

STOP_EN = """a an the and or but if of to in on at for with by is are was were be been this that these those it its as from not no yes
i you he she we they am do does did will would can could should may have has had about into over under than then there here so such too
very also up down out off my your his her our their"""

POS_WORDS = {
    "r": "我 你 他 她 它 我们 你们 他们 她们 它们 自己 大家 谁 什么 怎么 如何 这 那 这个 那个 这些 那些",
    "u": "的 地 得 了 着 过 吗 呢 吧 啊 呀 所 等 等等 之 其",
    "p": "在 从 向 对 把 被 让 给 为 为了 关于 通过 根据 按照 对于 由于 除了",
    "c": "和 与 或 及 以及 并 而 而且 并且 或者 但是 但 因为 所以 如果 虽然 然而 于是 因此",
    "d": "很 更 最 非常 特别 太 都 也 还 又 再 只 就 才 不 没 没有 别 已经 正在 将 会 要",
    "m": "一 二 两 三 四 五 六 七 八 九 十 百 千 万 亿",
    "q": "个 些 种 次 年 月 天 岁 元",
    "t": "今天 明天 昨天 现在 未来 过去 时间",
    "f": "上 下 中 里 内 外 前 后 左 右",
}

POSITIVE = """好 优秀 良好 出色 精彩 完美 棒 赞 喜欢 爱 满意 高兴 开心 快乐 幸福 愉快 兴奋 惊喜 欣喜 美好 美丽 漂亮 优雅 可爱 迷人 温暖 温馨 感动
感激 感谢 感恩 支持 赞成 赞同 认可 肯定 信任 可靠 稳定 安全 健康 强大 强劲 增长 提升 提高 进步 成功 胜利 领先 优势 卓越 杰出 伟大 方便 便捷 快速
高效 智能 先进 创新 新颖 独特 舒适 轻松 简洁 清晰 准确 精确 正确 合理 公平 丰富 全面 完整 充足 优质 高级 高端 精致 细致 细心 周到 贴心 友好 热情
真诚 诚实 善良 乐观 积极 向上 努力 勤奋 勇敢 坚强 自信 果断 顺利 流畅 顺畅 利好 看好 值得 推荐 畅销 火爆 热门 爆款 红火 繁荣 兴旺 发达 富裕 富饶
丰收 突破 改善 优化 升级 圆满 辉煌 荣耀 荣誉"""

NEGATIVE = """坏 差 糟糕 恶劣 失败 失望 讨厌 恨 烦 累 难过 伤心 悲伤 痛苦 悲哀 沮丧 郁闷 焦虑 担忧 担心 害怕 恐惧 惊慌 生气 愤怒 恼火 烦躁 厌倦 无聊
乏味 平淡 平庸 难看 丑陋 恶心 反感 厌恶 不满 抱怨 投诉 批评 反对 否定 怀疑 质疑 不信 欺骗 虚假 伪造 抄袭 侵权 违法 违规 危险 威胁 风险 危机 衰退
下降 降低 减少 损失 亏损 亏本 崩溃 故障 错误 缺陷 缺点 漏洞 问题 困难 艰难 复杂 麻烦 繁琐 累赘 混乱 杂乱 粗糙 简陋 低劣 低端 廉价 劣质 次品 破损
损坏 污染 浪费 昂贵 缓慢 迟钝 笨拙 愚蠢 愚昧 落后 保守 僵化 陈旧 消极 悲观 颓废 懒惰 怯懦 软弱 依赖 犹豫 拖延 破产 倒闭 裁员 失业 贫困 贫穷 饥荒
灾难 事故 伤亡 死亡 疾病 疫情 战争 冲突 暴力 侵略 破坏 摧毁 毁灭 恶化 加剧 严重 惨重"""

DEGREE = {
    "极其": 3.0, "极": 3.0, "极度": 3.0, "非常": 2.5, "十分": 2.5, "特别": 2.5, "尤其": 2.5, "格外": 2.5, "分外": 2.5, "最为": 3.0, "最": 2.0,
    "很": 1.8, "挺": 1.8, "太": 2.0, "真": 1.8, "好": 1.8, "相当": 1.8, "比较": 1.5, "较": 1.5, "有点": 1.3, "有些": 1.3, "稍微": 1.2, "略微": 1.2,
    "略": 1.2, "稍": 1.2, "更加": 2.0, "更": 1.8, "越来越": 2.0, "越发": 2.0, "颇": 1.8, "蛮": 1.5, "十足": 2.5, "完全": 2.0, "绝对": 2.5,
    "彻底": 2.0,
}

NEGATION = "不 没 没有 无 非 别 未 莫 勿 否认"

LOCATIONS = """北京 上海 广州 深圳 香港 澳门 台湾 天津 重庆 杭州 南京 苏州 无锡 成都 武汉 西安 长沙 郑州 青岛 大连 沈阳 哈尔滨 长春 石家庄 太原 济南 合肥
南昌 福州 厦门 昆明 贵阳 南宁 海口 三亚 拉萨 乌鲁木齐 兰州 西宁 银川 呼和浩特 珠江三角洲 长江 黄河 珠江 太平洋 亚洲 欧洲 美洲 非洲 大洋洲"""

ORGANIZATIONS = """国务院 教育部 科技部 财政部 中国人民银行 国家统计局 联合国 世界卫生组织 国际货币基金组织 世界银行 欧盟 北京大学 清华大学 复旦大学 浙江大学
上海交通大学 中国科学院 中国工程院 阿里巴巴 腾讯 百度 华为 字节跳动 京东 美团 小米 苹果 谷歌 微软 亚马逊 特斯拉 英伟达 中国移动 中国石油 中国银行 工商银行"""

PERSONS = """习近平 邓小平 毛泽东 周恩来 朱德 钱学森 袁隆平 屠呦呦 杨振宁 李政道 鲁迅 巴金 老舍 莫言 马云 马化腾 任正非 雷军 张一鸣 李彦宏 丁磊 乔布斯
比尔盖茨 马斯克 巴菲特 贝索斯 扎克伯格"""

ORG_SUFFIXES = "公司 集团 大学 学院 研究所 研究院 中心 委员会 协会 银行 基金会 医院 部门 总局 政府 法院 检察院"
LOC_SUFFIXES = "省 市 县 区 镇 村 街道 路 大道 山 河 湖 海 岛 湾 公园 广场 机场 车站 港口"
TITLES = "先生 女士 小姐 同志 老师 教授 博士 经理 局长 主席 书记"
GIVEN_NAME_CHARACTERS = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰春凤梅红萍琳雪峰辉斌宇浩凯文轩阳晨琪欣怡然雨桐子涵诗博俊"

TAGS = ("n", "v", "a", "d", "r", "p", "c", "u", "m", "q", "t", "f", "ns", "nr", "nt", "x")
SUFFIX_TAGS = {
    "们": ("n", "r"), "者": ("n",), "员": ("n",), "家": ("n",), "性": ("n", "a"), "度": ("n",), "率": ("n",), "量": ("n",), "子": ("n",),
    "头": ("n",), "化": ("v", "n"), "了": ("u", "v"), "着": ("u", "v"), "过": ("u", "v"), "的": ("u", "a"), "地": ("u", "d"), "得": ("u", "v"),
    "上": ("f", "n"), "下": ("f", "n"), "中": ("f", "n"), "里": ("f", "n"), "内": ("f", "n"), "外": ("f", "n"), "前": ("f", "t"), "后": ("f", "t"),
}

TAGGED_SENTENCES = """自然语言/n 处理/v 是/v 人工智能/n 的/u 重要/a 分支/n
我/r 喜欢/v 自然语言/n 处理/v
北京/ns 是/v 中国/ns 的/u 首都/n
今天/t 天气/n 非常/d 好/a
他/r 在/p 公司/n 工作/v
我们/r 正在/d 开发/v 一个/m 系统/n
这个/r 算法/n 的/u 性能/n 很/d 优秀/a
你/r 应该/v 学习/v 编程/n
人工智能/n 技术/n 发展/v 迅速/a
上海/ns 的/u 经济/n 十分/d 发达/a
她/r 非常/d 喜欢/v 阅读/v
我们/r 需要/v 提高/v 系统/n 效率/n
苹果/n 公司/n 发布/v 了/u 新/a 产品/n
研究/n 表明/v 数据/n 分析/n 很/d 重要/a
他们/r 通过/p 网络/n 传输/v 数据/n
小明/nr 在/p 学校/n 学习/v
政府/n 出台/v 了/u 新/a 政策/n
这个/r 问题/n 非常/d 复杂/a
科学家/n 发现/v 了/u 新/a 物种/n
市场/n 需求/n 持续/d 增长/v
我们/r 应该/v 保护/v 环境/n
他/r 成功/a 地/u 完成/v 了/u 任务/n
中国/ns 经济/n 保持/v 稳定/a 增长/v
老师/n 耐心/a 地/u 讲解/v 知识/n
机器/n 学习/v 是/v 当前/t 热门/a 方向/n
我/r 认为/v 这个/r 方案/n 可行/a
公司/n 员工/n 数量/n 不断/d 增加/v
他/r 在/p 北京/ns 工作/v 三年/m
语言/n 模型/n 取得/v 重大/a 突破/n
我们/r 需要/v 更加/d 高效/a 的/u 方法/n
医院/n 引进/v 了/u 先进/a 设备/n
价格/n 上涨/v 了/u 百分之/m 十/m
她/r 是/v 一名/m 优秀/a 的/u 工程师/n
春节/t 期间/f 人们/n 返乡/v 团圆/v
这份/r 报告/n 详细/a 地/u 分析/v 了/u 市场/n
人工智能/n 将/d 深刻/d 改变/v 人类/n 社会/n
我们/r 坚信/v 未来/t 会/v 更加/d 美好/a"""

LABELLED = {
    "positive": """这个产品非常好用，我很喜欢
质量优秀，值得推荐
这本书内容很精彩
系统运行稳定，速度快
外观漂亮，做工精致
整体感觉还不错
性能强劲，效率很高
他今天心情很好
这部电影非常感人
问题解决了，一切顺利
这个方案基本可行
数据结果准确可靠
还不错，可以接受
非常满意的一次购物
效果立竿见影
令人惊喜的进步""",
    "negative": """服务态度很差，让人失望
价格太贵了，不太划算
客服回复很慢，体验糟糕
味道难吃，不会再来
界面混乱，操作麻烦
性价比很低，不建议购买
这部电影很无聊
出现了严重故障
这个方案风险很大
数据存在明显错误
实在太差劲了
令人愤怒的体验
效果微乎其微
令人担忧的下降""",
    "neutral": """今天天气一般般
体验普普通通
没有什么特别的
表现中规中矩
态度还算可以
各方面表现均衡""",
}

ZH_EN = {
    "我": "I", "你": "you", "他": "he", "她": "she", "它": "it", "我们": "we", "你们": "you", "他们": "they", "是": "is", "有": "have", "在": "in",
    "和": "and", "的": "of", "喜欢": "like", "爱": "love", "想": "want", "说": "say", "看": "see", "学习": "learn", "工作": "work", "生活": "life",
    "研究": "research", "开发": "develop", "使用": "use", "实现": "implement", "提供": "provide", "支持": "support", "帮助": "help", "需要": "need",
    "可以": "can", "今天": "today", "明天": "tomorrow", "昨天": "yesterday", "现在": "now", "未来": "future", "时间": "time", "世界": "world",
    "国家": "country", "中国": "China", "美国": "America", "日本": "Japan", "北京": "Beijing", "上海": "Shanghai", "公司": "company",
    "大学": "university", "学校": "school", "老师": "teacher", "学生": "student", "朋友": "friend", "家庭": "family", "孩子": "child",
    "人": "people", "人类": "human", "社会": "society", "经济": "economy", "科技": "technology", "技术": "technology", "计算机": "computer",
    "互联网": "internet", "人工智能": "artificial intelligence", "数据": "data", "信息": "information", "系统": "system", "平台": "platform",
    "网络": "network", "软件": "software", "硬件": "hardware", "程序": "program", "算法": "algorithm", "模型": "model", "语言": "language",
    "自然语言": "natural language", "文本": "text", "新闻": "news", "文章": "article", "问题": "problem", "方法": "method", "结果": "result",
    "过程": "process", "目标": "goal", "功能": "function", "性能": "performance", "质量": "quality", "速度": "speed", "效率": "efficiency",
    "成本": "cost", "价格": "price", "市场": "market", "产品": "product", "服务": "service", "用户": "user", "客户": "customer", "设计": "design",
    "管理": "manage", "分析": "analyze", "教育": "education", "健康": "health", "环境": "environment", "资源": "resource", "能源": "energy",
    "金融": "finance", "银行": "bank", "投资": "investment", "股票": "stock", "基金": "fund", "你好": "hello", "谢谢": "thank you",
    "再见": "goodbye", "对不起": "sorry", "早上好": "good morning", "晚上好": "good evening", "机器学习": "machine learning",
    "深度学习": "deep learning", "神经网络": "neural network", "大数据": "big data", "云计算": "cloud computing", "物联网": "internet of things",
    "我喜欢": "I like", "非常好": "very good", "很好": "very good", "很大": "very big", "很重要": "very important", "好": "good", "坏": "bad",
    "大": "big", "小": "small", "多": "many", "少": "few", "高": "high", "低": "low", "长": "long", "短": "short", "新": "new", "旧": "old",
    "快": "fast", "慢": "slow", "重要": "important", "简单": "simple", "复杂": "complex", "正确": "correct", "错误": "wrong", "准确": "accurate",
    "稳定": "stable", "安全": "safe", "快速": "fast", "高效": "efficient", "智能": "intelligent", "自动": "automatic", "一": "one", "二": "two",
    "三": "three", "四": "four", "五": "five", "六": "six", "七": "seven", "八": "eight", "九": "nine", "十": "ten", "年": "year", "月": "month",
    "日": "day", "小时": "hour", "分钟": "minute",
}

KEY_TAGS = ("n", "v", "a", "ns", "nr", "nt", "vn")
KEY_STOP = "一个 一种 这个 那个 这些 那些 自己 可以 可能 应该 需要 进行 表示 认为 知道 觉得 开始 结束 完成 成为 使用 提供 支持 包括"

TAG_NAMES = {
    "n": "名词", "v": "动词", "a": "形容词", "d": "副词", "r": "代词", "p": "介词", "c": "连词", "u": "助词", "m": "数词", "q": "量词",
    "t": "时间词", "f": "方位词", "ns": "地名", "nr": "人名", "nt": "机构", "x": "其他",
}
RELATION_NAMES = {
    "root": "核心", "nsubj": "主语", "dobj": "宾语", "amod": "定语修饰", "nummod": "数量修饰", "advmod": "状语修饰", "conj": "并列", "mark": "助词",
    "case": "介词", "clf": "量词", "lobj": "方位", "tmod": "时间修饰", "compound": "复合词", "punct": "标点", "attr": "系词补语", "dep": "其它",
}
PHRASE_NAMES = {
    "S": "句子", "NP": "名词短语", "VP": "动词短语", "AP": "形容词短语", "PP": "介词短语", "ADVP": "副词短语", "P": "介词", "CONJ": "连词",
    "U": "助词", "TP": "时间短语",
}
ENTITY_NAMES = {
    "PERSON": "人名", "LOCATION": "地名", "ORGANIZATION": "机构", "TIME": "时间", "DATE": "日期", "NUMBER": "数字", "MONEY": "金额",
    "PERCENT": "百分比",
}
POLARITY_NAMES = {
    "positive": "积极", "negative": "消极", "neutral": "中性",
}

# The grammar of phrases, in the order that decides between derivations; labels from most to least preferred.
GRAMMAR = (
    ("NP", ("n",)), ("NP", ("r",)), ("NP", ("ns",)), ("NP", ("nr",)), ("NP", ("nt",)), ("NP", ("t",)), ("NP", ("f",)), ("NP", ("m",)), ("NP", ("q",)), ("NP", ("x",)),
    ("VP", ("v",)), ("AP", ("a",)), ("ADVP", ("d",)), ("P", ("p",)), ("CONJ", ("c",)), ("U", ("u",)),
    ("NP", ("a", "n")), ("NP", ("m", "n")), ("NP", ("m", "q")), ("NP", ("NP", "NP")), ("NP", ("NP", "U")), ("NP", ("NP", "PP")), ("NP", ("n", "v")), ("NP", ("v", "n")),
    ("VP", ("v", "NP")), ("VP", ("v", "VP")), ("VP", ("d", "VP")), ("VP", ("ADVP", "VP")), ("VP", ("VP", "U")), ("VP", ("VP", "PP")), ("VP", ("VP", "NP")),
    ("AP", ("d", "AP")), ("AP", ("ADVP", "AP")), ("PP", ("P", "NP")), ("TP", ("NP", "f")),
    ("S", ("NP", "VP")), ("S", ("NP", "AP")), ("S", ("NP", "TP")), ("S", ("S", "PP")), ("S", ("S", "CONJ")),
)
PREFERENCE = ("S", "VP", "NP", "AP", "TP", "PP", "ADVP", "P", "CONJ", "U")

# ---------------------------------------------------------------------------------------------------------------------


def words(text: str) -> tuple[str, ...]:
    """The distinct words of a list, in its order."""
    return tuple(dict.fromkeys(text.split()))


def read_dictionary(lines: Iterable[str], onto: dict[str, int] | None = None) -> dict[str, int]:
    """word -> frequency of lines `word [frequency [anything]]`, on top of another dictionary.

    The greatest frequency of a word counts, 1 where none is given. Lines that begin with # are comments.
    """
    out = dict(onto or {})
    for line in lines:
        parts = line.split()
        if parts and not line.startswith("#"):
            out[parts[0]] = max(out.get(parts[0], 0), int(parts[1]) if len(parts) > 1 else 1)
    return out


@cache
def _data(name: str) -> tuple[str, ...]:
    """The lines of one of the package's data files, without comments."""
    text = pkgutil.get_data("inkstone", f"data/{name}").decode()
    return tuple(line for line in text.splitlines() if not line.startswith("#"))


def default_dictionary() -> dict[str, int]:
    return read_dictionary(w for line in _data("words.txt") for w in line.split())


def default_surnames() -> frozenset[str]:
    return frozenset("".join(_data("surnames.txt")))


def _tagged_sentences() -> list[list[tuple[str, str]]]:
    return [[tuple(t.split("/")) for t in line.split()] for line in TAGGED_SENTENCES.splitlines()]


def _labelled_texts() -> list[tuple[str, str]]:
    return [(line, label) for label, text in LABELLED.items() for line in text.splitlines()]


def _constant(value):
    return field(default_factory=lambda: value)


@dataclass(frozen=True)
class Lexicon:
    """All word lists and training sentences an analysis uses; every one of them can be given.

    dictionary: word -> frequency, what texts are segmented with. A larger one is best merged with the default by
    `Lexicon.with_dictionary`. tagged: sentences of (word, tag). labelled: (text, label). grammar: (label, parts) of one or two
    parts each, in the order that decides between derivations; preference: labels from most to least preferred.
    """

    dictionary: dict[str, int] = field(default_factory=default_dictionary)
    surnames: frozenset[str] = field(default_factory=default_surnames)
    given_characters: frozenset[str] = frozenset(GIVEN_NAME_CHARACTERS)
    stop_words: frozenset[str] = frozenset(words(STOP_ZH) + words(STOP_EN))
    locations: frozenset[str] = frozenset(words(LOCATIONS))
    organizations: frozenset[str] = frozenset(words(ORGANIZATIONS))
    persons: frozenset[str] = frozenset(words(PERSONS))
    positive: frozenset[str] = frozenset(words(POSITIVE))
    negative: frozenset[str] = frozenset(words(NEGATIVE))
    negation: frozenset[str] = frozenset(words(NEGATION))
    degree: dict[str, float] = _constant(DEGREE)
    parts_of_speech: dict[str, str] = _constant({w: tag for tag, text in POS_WORDS.items() for w in text.split()})
    tags: tuple[str, ...] = TAGS
    tagged: list[list[tuple[str, str]]] = field(default_factory=_tagged_sentences)
    suffix_tags: dict[str, tuple[str, ...]] = _constant(SUFFIX_TAGS)
    labelled: list[tuple[str, str]] = field(default_factory=_labelled_texts)
    zh_en: dict[str, str] = _constant(ZH_EN)
    organization_suffixes: tuple[str, ...] = words(ORG_SUFFIXES)
    location_suffixes: tuple[str, ...] = words(LOC_SUFFIXES)
    titles: tuple[str, ...] = words(TITLES)
    key_tags: tuple[str, ...] = KEY_TAGS
    key_stop: tuple[str, ...] = words(KEY_STOP)
    grammar: tuple[tuple[str, tuple[str, ...]], ...] = GRAMMAR
    preference: tuple[str, ...] = PREFERENCE

    @classmethod
    def with_dictionary(cls, lines: Iterable[str], **others) -> "Lexicon":
        """A lexicon whose dictionary is the default one with the words of `lines` (as of a file), the greater frequency of each."""
        return cls(dictionary=read_dictionary(lines, default_dictionary()), **others)

    @cached_property
    def fingerprint(self) -> str:
        parts = [sorted(x) if isinstance(x, frozenset) else sorted(x.items()) if f.name == "dictionary" else list(x.items()) if isinstance(x, dict) else x for f in fields(self) for x in [getattr(self, f.name)]]
        return hashlib.md5(repr(parts).encode()).hexdigest()

    @cached_property
    def en_zh(self) -> dict[str, str]:
        """English to Chinese: the first word with a translation counts."""
        out: dict[str, str] = {}
        for zh, en in self.zh_en.items():
            out.setdefault(en.lower(), zh)
        return out


DEFAULT = Lexicon()
