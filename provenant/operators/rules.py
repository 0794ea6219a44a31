"""Domain rules as tables: offence names, terms for plain words, articles that must be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of offences by article of the criminal law.
CRIMINAL_LAW = "中华人民共和国刑法"
OFFENCES = (
    ("第一百二十条之一", "帮助恐怖活动罪"),
    ("第一百五十一条", "走私武器、弹药罪；走私核材料罪；走私假币罪；走私文物罪；走私贵重金属罪；走私珍贵动物、珍贵动物制品罪；走私国家禁止进出口的货物、物品罪"),
    ("第一百五十三条", "走私普通货物、物品罪"),
    ("第一百七十六条", "非法吸收公众存款罪"),
    ("第一百七十七条之一", "妨害信用卡管理罪；窃取、收买、非法提供信用卡信息罪"),
    ("第一百八十七条", "吸收客户资金不入帐罪"),
    ("第一百九十条", "逃汇罪"),
    ("第一百九十一条", "洗钱罪"),
    ("第一百九十二条", "集资诈骗罪"),
    ("第二百零一条", "逃税罪"),
    ("第二百零四条", "骗取出口退税罪"),
    ("第二百二十五条", "非法经营罪"),
    ("第二百六十六条", "诈骗罪"),
    ("第二百八十七条之一", "非法利用信息网络罪"),
    ("第二百八十七条之二", "帮助信息网络犯罪活动罪"),
    ("第三百一十二条", "掩饰、隐瞒犯罪所得、犯罪所得收益罪"),
    ("第三百四十九条", "包庇毒品犯罪分子罪；窝藏、转移、隐瞒毒品、毒赃罪"),
    ("第三百八十二条", "贪污罪"),
    ("第三百八十五条", "受贿罪"),
)

# Patterns of plain words and the terms that they add to a query.
SETTLED_ACROSS = (
    r"(国内|境内).{0,6}(收|付|给|转).{0,4}人民币.{0,20}"
    r"(国外|境外|海外|香港|澳门).{0,8}(付|给|收|拿|到账|代付|支付|付款)"
)
GLOSSARY = (
    (r"走账|过账|跑分|刷流水|(出租|出借|出售|借|租|卖).{0,4}(银行卡|账户|U盾|网银)|(银行卡|账户|U盾|网银).{0,6}(借|租|卖)给|卖卡|收卡|卡农|两卡", "帮助信息网络犯罪活动罪 提供支付结算帮助 出租、出借、出售银行账户 电话卡"),
    (r"地下钱庄|私下换汇|换汇黄牛|对敲|对冲换汇|私人换汇|" + SETTLED_ACROSS, "非法买卖外汇 变相买卖外汇 资金跨国（境）兑付 对敲型地下钱庄 两地平衡 非法从事资金支付结算业务 非法经营罪"),
    (r"洗白|漂白|黑钱|赃款|(贩毒|诈骗|受贿|贪污|走私|集资|赌博|盗窃).{0,6}(的钱|所得|赚的|收益|款)", "洗钱 掩饰、隐瞒犯罪所得及其收益的来源和性质"),
    (r"(不|没有?|未)(向海关)?(申报|报关|报备)|漏报", "违反规定携带外汇出入境 处罚 海关申报"),
    (r"上游犯罪", "洗钱罪 刑法第一百九十一条 毒品犯罪 黑社会性质的组织犯罪 恐怖活动犯罪 走私犯罪 贪污贿赂犯罪 破坏金融管理秩序犯罪 金融诈骗犯罪"),
    (r"带.{0,4}(现金|美元|外币|钱).{0,6}(出境|出国|出关)|出境.{0,6}带.{0,4}(现金|美元|外币|钱)", "携带外币现钞出境 携带外汇出境许可证 海关申报"),
    (r"换成?美元|买美元|兑换.{0,4}(美元|外币|外汇)|换外币|换汇|每年.{0,4}能换|购汇", "个人购汇 年度便利化额度 等值5万美元"),
    (r"(海外|境外|国外).{0,4}(买房|购房|置业)|(买房|购房).{0,6}(海外|境外|国外)", "个人境外购房 资本项目 境外投资 房地产 敏感行业"),
    (r"比特币|泰达币|USDT|虚拟币|数字货币|加密货币|币圈", "虚拟货币 虚拟货币交易炒作 非法金融活动"),
    (r"汇钱到?(国外|境外|海外)|往(国外|境外|海外).{0,4}(汇|转)钱|境外汇款|跨境汇款", "跨境汇款 资金汇出 购汇 付汇 真实性审核"),
    (r"拆分|分拆|化整为零|蚂蚁搬家|(每人|分别|几个人|亲戚|朋友|家人|同事).{0,10}(帮我|替我|代我)?.{0,4}(换|购汇|换汇|汇)", "分拆购汇 规避便利化额度 关注名单"),
    (r"大额.{0,4}(存取|取现|现金)|取.{0,4}大额现金", "大额现金交易 大额交易报告 人民币5万元"),
    (r"空壳公司|实际控制人|最终受益人|背后老板", "受益所有人 受益所有人信息 客户尽职调查"),
)

# Patterns of questions and the articles that an answer must be given with.
CUSTOMS_PENALTIES, EXCHANGE_RULES, FRAUD_LAW = "中华人民共和国海关行政处罚实施条例", "中华人民共和国外汇管理条例", "中华人民共和国反电信网络诈骗法"
BANK_ANSWERS = "依法惩治涉“地下钱庄”犯罪 维护金融市场秩序 ——最高人民法院刑三庭、最高人民检察院法律政策研究室负责人就涉地下钱庄刑事案件司法解释答记者问"
BANK_READING = "最高人民法院+最高人民检察院关于办理非法从事资金支付结算业务、非法买卖外汇刑事案件适用法律若干问题的解释"
EXCHANGE_DECISION = "全国人民代表大会常务委员会关于惩治骗购外汇、逃汇和非法买卖外汇犯罪的决定"
REQUIRED = (
    (r"(?<!反)洗钱|洗白|掩饰.{0,4}隐瞒", ((CRIMINAL_LAW, "第一百九十一条"), (CRIMINAL_LAW, "第三百一十二条"))),
    (r"集资", ((CRIMINAL_LAW, "第一百七十六条"), (CRIMINAL_LAW, "第一百九十二条"))),
    (r"(不|没有?|未)(向海关)?(申报|报关|报备)|漏报", ((EXCHANGE_RULES, "第四十二条"), (CUSTOMS_PENALTIES, "第十九条"))),
    (r"(出租|出借|出售|借|租|卖).{0,4}(银行卡|账户|U盾|网银)|(银行卡|账户|U盾|网银).{0,6}(借|租|卖)给|卖卡|收卡|两卡", ((FRAUD_LAW, "第三十一条"),)),
    (
        r"对敲|地下钱庄|对冲换汇|换汇黄牛|私下(买卖|换|兑换).{0,4}(外汇|美元|外币|港币)|" + SETTLED_ACROSS,
        ((BANK_ANSWERS, "第5问"), (BANK_READING, "第二条"), (EXCHANGE_RULES, "第四十五条"), (CRIMINAL_LAW, "第二百二十五条")),
    ),
    (
        r"骗购外汇|(假|虚假|伪造|变造).{0,10}(单据|单子|单证|报关单|合同|发票|贸易).{0,20}(购汇|换汇|换成?美元|汇出)|"
        r"(购汇|换汇).{0,20}(假|虚假|伪造).{0,6}(单据|单子|单证|报关单|贸易)",
        ((EXCHANGE_DECISION, "第一项"), (EXCHANGE_RULES, "第四十条")),
    ),
)


def glossary(spark: SparkSession, rows: tuple = GLOSSARY) -> DataFrame:
    """(ord, pattern, terms)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, pattern string, terms string")


def required(spark: SparkSession, rows: tuple = REQUIRED) -> DataFrame:
    """(pattern, doc_title, article)."""
    return spark.createDataFrame([(p, *a) for p, articles in rows for a in articles], "pattern string, doc_title string, article string")


def aliases(spark: SparkSession) -> DataFrame:
    """(doc_title, article, alias)."""
    return spark.createDataFrame([(CRIMINAL_LAW, *r) for r in OFFENCES], "doc_title string, article string, alias string")


def with_alias(chunks: DataFrame) -> DataFrame:
    """Chunks with the offence that their article names, or an empty alias. The table that is broadcast is the one above."""
    return chunks.drop("alias").join(F.broadcast(aliases(chunks.sparkSession)), ["doc_title", "article"], "left").fillna("", ["alias"])
