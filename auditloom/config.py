"""Defaults of all operators: thresholds, weights, word lists and patterns, passed as arguments everywhere."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicons:
    """Word lists and patterns that results depend on."""

    positive: tuple[str, ...] = ("利好", "上涨", "增长", "优秀", "强劲", "超预期")
    negative: tuple[str, ...] = ("利空", "下跌", "下降", "风险", "压力", "低于预期")
    polar_positive: tuple[str, ...] = ("利好", "上涨", "增长", "优秀", "强劲")
    polar_negative: tuple[str, ...] = ("利空", "下跌", "下降", "风险", "压力")
    contradiction: tuple[str, ...] = ("但是", "然而", "不过", "相反", "相对地", "另一方面", "与此相反", "矛盾的是", "截然不同", "完全相反")
    uncertainty: tuple[str, ...] = ("可能", "或许", "大概", "估计", "预计", "推测", "据说", "传言", "听说", "不确定", "尚不清楚")
    source_patterns: tuple[str, ...] = ("据.*消息", "某.*人士", "内部.*透露", "匿名.*表示", "不愿.*透露.*姓名", "知情.*人士", "可靠.*消息.*源")
    formal: tuple[str, ...] = ("认为", "预计", "分析", "研究", "数据")
    casual: tuple[str, ...] = ("觉得", "可能", "估计", "大概", "感觉")
    number_patterns: tuple[str, ...] = (r"(\d+\.?\d*)\s*%", r"(\d+\.?\d*)\s*倍", r"(\d+\.?\d*)\s*元", r"(\d+\.?\d*)\s*亿", r"(\d+\.?\d*)\s*万", r"增长\s*(\d+\.?\d*)", r"下降\s*(\d+\.?\d*)", r"目标价\s*(\d+\.?\d*)")
    disclaimer: str = "(?i)免责声明|风险提示|投资建议|市场有风险|投资需谨慎|本报告|仅供参考"
    advertisement: str = "(?i)广告|推广|扫码|微信|QQ|电话|邮箱|网址|链接"
    contact: str = r"(\d{3,4}[-\s]?\d{7,8})|(\w+@\w+\.\w+)|(www\.\w+\.\w+)"
    ratings: tuple[str, ...] = ("买入", "增持", "中性", "减持", "卖出")
    sentence_end: str = "[。！？]"


LEXICONS = Lexicons()


@dataclass(frozen=True)
class Thresholds:
    """Thresholds and weights of the detectors and of their fusion."""

    length_z: float = 2.0
    novelty: float = 0.15
    sentiment_z: float = 2.5
    number_deviation: float = 0.5
    statistical_weights: tuple[float, ...] = (0.2, 0.3, 0.3, 0.2)
    timing_hours: int = 24
    timing: float = 0.1
    frequency_days: int = 30
    frequency_ratio: float = 2.0
    focus: float = 0.3
    writing_z: float = 2.0
    behavioral_weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)
    market_weights: tuple[float, ...] = (0.3, 0.25, 0.25, 0.2)
    semantic_weights: tuple[float, ...] = (0.3, 0.3, 0.2, 0.2)
    family_weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)
    levels: tuple[tuple[float, str], ...] = ((0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW"))


THRESHOLDS = Thresholds()


# Words that segmentation leaves out, and words that it keeps whole; results depend on them.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个",
    "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好",
    "自己", "这", "那", "就是", "我们", "他们", "她们", "可以", "能够", "因为",
    "所以", "但是", "然后", "如果", "虽然", "却", "还是", "已经", "现在", "之后",
    "之前", "比较", "非常", "特别", "尤其", "包括", "以及", "或者", "并且", "而且",
    "这个", "那个", "这些", "那些", "什么", "怎么", "为什么", "怎样", "哪里",
    "什么时候", "多少", "几个", "一些", "许多", "很多", "不少", "大量", "少量",
)
FINANCE_WORDS = (
    "股票", "股价", "涨幅", "跌幅", "市值", "成交量", "换手率", "市盈率", "市净率",
    "营收", "净利润", "毛利率", "ROE", "ROA", "EPS", "PE", "PB", "PEG",
    "券商", "研报", "评级", "目标价", "买入", "卖出", "持有", "增持", "减持",
    "上涨", "下跌", "横盘", "震荡", "突破", "支撑", "阻力", "趋势", "反弹",
    "业绩", "财报", "年报", "季报", "分红", "派息", "配股", "增发", "重组",
    "并购", "IPO", "上市", "退市", "停牌", "复牌", "限售", "解禁",
)
# What each issue of a cleaned text takes off its quality.
CLEAN_PENALTIES = {"text_too_short": 0.3, "text_too_long": 0.1, "possible_gibberish": 0.4, "high_repetition": 0.2, "low_chinese_ratio": 0.3}
# Kinds of numbers in reports, and the patterns that find them.
NUMBER_KINDS = (
    ("money_wan", r"(\d+\.?\d*)\s*万元"), ("money_yi", r"(\d+\.?\d*)\s*亿元"), ("money_yuan", r"(\d+\.?\d*)\s*元"), ("percentage", r"(\d+\.?\d*)%"),
    ("pe_ratio", r"市盈率\s*(\d+\.?\d*)"), ("pb_ratio", r"市净率\s*(\d+\.?\d*)"), ("multiple", r"(\d+\.?\d*)\s*倍"), ("target_price", r"目标价\s*(\d+\.?\d*)"),
    ("year", r"(\d{4})年"), ("shares_wan", r"(\d+\.?\d*)\s*万股"),
)
