"""Built-in word lists and what is found with them (RUL6-RUL8, TXT3, TXT4, PRJ13, AGG22, AGG23).

Hits that compete for the same characters are settled inside one text, by a small Arrow function for each batch; texts are
never joined to the lists row by row here. scan.word_hits counts hits without settling them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import IGNORED, ZERO_WIDTH, clause_coverage, party_pairs

#: Superlatives that advertising law restricts, by risk.
AD_WORDS = {
    "high": (
        "国家级 最高级 最佳 最好 最优 最强 最高 最低 最便宜 最省 最划算 最先进 顶级 顶尖 极致 极品 绝对 万能 "
        "第一品牌 销量第一 行业第一 全国第一 世界第一 全球第一 排名第一 中国第一 "
        "独一无二 绝无仅有 史无前例 前所未有 前无古人 百分百 百分之一百 100% 全网最低 史上最低 最优秀 最专业"
    ).split(),
    "medium": "第一 唯一 首选 首创 独家 领先 领导者 领军 最新 最热 最受欢迎 最优惠 超值 超级 极致体验 最好用 最靠谱 销量冠军 口碑第一 遥遥领先".split(),
    "low": "特效 速效 根治 无副作用 彻底 完全 永久 终身 包治 药到病除 神奇 立竿见影".split(),
}
LEVELS = {"high": 3, "medium": 2, "low": 1}
#: Phrases in which such a word is a plain fact.
AD_EXEMPT = (
    r"最佳(?:食用|赏味|保存|使用|饮用|保质)期?",
    r"第[一二三四五六七八九十百千万0-9]+(?:名|次|步|层|章|节|批|轮|天|年|季度|周|版|条|款|项|位|集|季)",
    r"最(?:高|低)(?:气温|温度|海拔|气压|水位|时速)",
    r"最大(?:载重|承重|容量|功率|马力|行程|续航)",
)
#: Words that market places ban: category|word|variants.
BANNED = """
导流|微信|weixin|wx|vx|薇信|威信|徽信|微❤信|v信|威❤信|weixinhao
导流|QQ|qq|扣扣|q号|企鹅号|企鵝號
导流|手机号|手机|电话|联系电话|联系方式|加手机|留电话
导流|二维码|扫码|扫一扫|长按识别|识别二维码|扫二维码
导流|加我|加v|加V|加薇|加微|加扣扣|加qq|加QQ
导流|公众号|公众號|官方公众号|官微
导流|小程序|小程续
导流|私信|私聊|私聊我|滴滴我|撩我|私我
导流|看主页|个人主页|主页有|主页联系
虚假宣传|包过|保过|包通过|保证通过|不过包退|包拿证
虚假宣传|百分百|百分之百|必过|稳过|一次过|包成功
虚假宣传|稳赚|稳赚不赔|零风险|无风险|包赚|保收益
虚假宣传|国家级|国家级别|国家权威|国家免检
虚假宣传|排名第一|全网第一|行业第一|全国第一|销量第一
虚假宣传|根治|彻底根治|彻底解决|一劳永逸
违规交易|刷单|刷销量|刷量|代刷|刷信誉|刷好评
违规交易|涨粉|买粉|刷粉|增粉|买粉丝
违规交易|买卖账号|出售账号|收购账号|租号|卖号
违规交易|代写|代做|代考|代刷课|代上课
违规交易|发票代开|代开发票|代开|办证|代办证件|刻章|代办资质
医疗夸大|根治|彻底治愈|包治|包治百病|药到病除|一次根治
医疗夸大|特效|特效药|奇效|神药|祖传秘方|独家秘方
医疗夸大|无副作用|无任何副作用|绝对安全|无痛无创|绝对有效
医疗夸大|增大|增粗|壮阳|延时|增大增粗
"""
#: Clauses of contracts, whether the law asks for them, and the words that name them.
CONTRACTS = {
    "general": [
        ("party", True, "甲方 乙方 买方 卖方 出租方 承租方 委托方 受托方 供方 需方 发包人 承包人 当事人 住所 注册地址"), ("subject", True, "标的 服务内容 货物 产品名称 项目内容 工程范围 工作内容 采购内容"),
        ("quantity", True, "数量 规格型号 面积 件数 台 吨 计量"), ("quality", True, "质量 验收 技术指标 合格 标准"), ("price", True, "价款 金额 报酬 费用 单价 总价 合同价 人民币 付款 支付 结算"),
        ("performance", True, "履行期限 期限 交货 交付 履行地点 履行方式 工期 服务期限"), ("breach", True, "违约 违约金 赔偿 逾期 滞纳金"), ("dispute", True, "争议 仲裁 诉讼 法院 管辖"),
        ("effect", False, "生效 终止 解除 有效期"), ("signature", False, "签字 盖章 签署 签订日期 订立日期"),
    ],
    "labor": [
        ("employer", True, "用人单位 公司名称 法定代表人 主要负责人 住所 甲方"), ("employee", True, "劳动者 乙方 身份证 住址 姓名"), ("term", True, "合同期限 固定期限 无固定期限 试用期 合同期"),
        ("job", True, "工作内容 工作岗位 工作地点 职务 岗位"), ("hours", True, "工作时间 工时 休息 休假 加班 年假 法定节假日"), ("wage", True, "劳动报酬 工资 薪资 薪酬 月薪"),
        ("insurance", True, "社会保险 社保 五险一金 养老保险 医疗保险"), ("protection", True, "劳动保护 劳动条件 职业危害 安全生产 职业病"), ("breach", False, "违约 赔偿 违约金"), ("signature", False, "签字 盖章 签署 签订日期"),
    ],
    "lease": [
        ("property", True, "租赁物 房屋 场地 设备 坐落 地址 商铺"), ("area", True, "面积 平方米 ㎡ 数量 间"), ("usage", True, "用途 用于 经营 居住 办公"), ("term", True, "租赁期限 租期 起租 止租 租赁期间"),
        ("rent", True, "租金 月租 押金 支付 付款 保证金"), ("repair", True, "维修 修缮 维护 保养"), ("breach", False, "违约 违约金 赔偿"), ("dispute", False, "争议 仲裁 诉讼 法院"),
    ],
}
#: The two sides of a contract.
PARTIES = [("甲方", "乙方"), ("买方", "卖方"), ("出租方", "承租方"), ("委托方", "受托方"), ("供方", "需方"), ("发包人", "承包人"), ("用人单位", "劳动者")]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _found(texts: Iterator[str], patterns: dict[str, int]) -> Iterator[list[tuple[int, int, int]]]:
    """For each text the occurrences (rank, start, end) of the patterns, in the order of their ranks, found in one pass over the text."""
    automaton = ahocorasick.Automaton()
    for p, rank in patterns.items():
        automaton.add_word(p, (rank, len(p)))
    if patterns:
        automaton.make_automaton()
    for t in texts:
        yield sorted((rank, end + 1 - size, end + 1) for end, (rank, size) in automaton.iter(t)) if patterns else []


def ad_findings(documents: DataFrame, *, allow: tuple[str, ...] = (), min_level: str = "low") -> DataFrame:
    """TXT3, RUL6: doc_id, start, line, word, level, context of each restricted word. Higher levels and longer words come first, and
    a word that begins inside a hit or an exempt phrase is none. A word's own occurrences don't overlap. One pass over a text, however
    long the list."""
    order = [(level, w) for level in LEVELS for w in sorted(AD_WORDS[level], key=len, reverse=True) if w not in allow]
    exempt = [re.compile(p) for p in AD_EXEMPT]

    def settled(text: str, found: list[tuple[int, int, int]]) -> list[tuple]:
        if not found:
            return []
        taken, out, last = bytearray(len(text)), [], (-1, 0)
        for p in exempt:
            for m in p.finditer(text):
                taken[m.start() : m.end()] = b"\1" * len(m[0])
        for rank, start, end in found:
            if rank == last[0] and start < last[1]:
                continue
            last = rank, end
            if not taken[start]:
                taken[start:end] = b"\1" * (end - start)
                level, w = order[rank]
                out.append((start, _line(text, start), w, level, text[max(0, start - 12) : end + 12].replace("\n", " ")))
        return sorted(x for x in out if LEVELS[x[3]] >= LEVELS[min_level])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t or "" for t in pdf.text]
            found = _found(iter(texts), {w: rank for rank, (_, w) in reversed(list(enumerate(order)))})
            yield pd.DataFrame([(d, *h) for d, t, f in zip(pdf.doc_id, texts, found, strict=True) for h in settled(t, f)], columns=["doc_id", "start", "line", "word", "level", "context"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, start int, line int, word string, level string, context string")


def banned_words(spark: SparkSession) -> DataFrame:
    """RUL7: category, word, variants; a list of one's own comes from sources.delimited.word_list."""
    rows = [line.split("|") for line in BANNED.strip().split("\n")]
    return spark.createDataFrame([(c, w, v) for c, w, *v in rows], "category string, word string, variants array<string>")


def _folded(text: str, ignored: re.Pattern) -> tuple[str, list[int]]:
    """The text in half width and lower case without ignorable characters, and where each of its characters stood."""
    chars, at = [], []
    for k, c in enumerate(text):
        c = chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else " " if c == "　" else c
        for x in c.lower():
            if not ignored.match(x):
                chars.append(x)
                at.append(k)
    return "".join(chars), at


def word_spans(documents: DataFrame, words: DataFrame, *, max_entries: int = 100_000) -> DataFrame:
    """TXT4, STR23: doc_id, category, word, matched, line of each banned word, however it is spaced, decorated or widened. An earlier
    entry of the list, and of its variants an earlier one, takes the characters first. One pass over a text, however long the
    list, which goes to the tasks after a check of its size."""
    listed = words.limit(max_entries + 1).collect()
    if len(listed) > max_entries:
        raise ValueError(f"a word list of more than {max_entries} entries; split it")
    ignored = re.compile(f"{IGNORED}|{ZERO_WIDTH}")
    entries = [(r.category, r.word, v) for r in listed for v in (_folded(x, ignored)[0] for x in [r.word, *(r.variants or [])]) if v]
    patterns = {v: rank for rank, (*_, v) in reversed(list(enumerate(entries)))}  # of equal ones the first

    def settled(text: str, folded: tuple[str, list[int]], found: list[tuple[int, int, int]]) -> list[tuple]:
        norm, at = folded
        taken, out = bytearray(len(norm)), []
        for rank, start, end in found:
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                a, b = at[start], at[end - 1] + 1
                out.append((a, *entries[rank][:2], text[a:b], _line(text, a)))
        return [x[1:] for x in sorted(out)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t or "" for t in pdf.text]
            folded = [_folded(t, ignored) for t in texts]
            found = _found((norm for norm, _ in folded), patterns)
            yield pd.DataFrame([(d, *h) for d, t, n, f in zip(pdf.doc_id, texts, folded, found, strict=True) for h in settled(t, n, f)], columns=["doc_id", "category", "word", "matched", "line"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, category string, word string, matched string, line int")


def contract_clauses(documents: DataFrame, profile: str = "general") -> DataFrame:
    """RUL8: doc_id, clause, required, hits, missing for a built-in profile: general, labor or lease."""
    rows = [(k, required, words.split()) for k, required, words in CONTRACTS[profile]]
    return clause_coverage(documents, documents.sparkSession.createDataFrame(rows, "clause string, required boolean, keywords array<string>"))


def contract_parties(documents: DataFrame) -> DataFrame:
    """AGG23: doc_id, pair, status of the sides that a contract names."""
    return party_pairs(documents, PARTIES)
