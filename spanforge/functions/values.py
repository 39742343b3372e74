"""Fixed values that results depend on: patterns, type names, labels, templates, states.  Plain tables, no logic."""

from __future__ import annotations

# Type, pattern, priority; matched without regard to case, in this order.
BUILTIN_PATTERNS = [
    ("ID_CARD", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b", 10),
    ("ID_CARD", r"\b[1-9]\d{5}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}\b", 9),
    ("PHONE", r"\b1[3-9]\d{9}\b", 10),
    ("PHONE", r"\b(?:0\d{2,3}[-\s]?)?\d{7,8}\b", 5),
    ("BANK_CARD", r"\b(?:62|4|5)\d{14,17}\b", 10),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 10),
    ("CASE_NUMBER", r"[\(（]\d{4}[\)）][京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领A-Z]{1,4}\d{0,4}[民刑行执破知赔财商][初终复再抗申裁监督撤]?\d+号", 10),
    ("CASE_NUMBER", r"[\(（]\d{4}[\)）][A-Za-z一-鿿]+\d*[A-Za-z一-鿿]*\d+号", 8),
    ("DATE", r"\d{4}年\d{1,2}月\d{1,2}日", 10),
    ("DATE", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", 9),
    ("MONEY", r"(?:人民币|￥|¥|RMB)?\s*[\d,]+(?:\.\d{1,2})?\s*(?:元|万元)?", 8),
    ("MONEY", r"\d[\d,]*(?:\.\d{1,2})?\s*(?:元|万元|亿元)", 9),
    ("LICENSE_PLATE", r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5,6}", 10),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 10),
    ("URL", r"https?://[^\s<>\"{}|\\^`\[\]]+", 10),
]

# Patterns for text read from images, matched with regard to case.
OCR_PATTERNS = [
    ("PHONE", r"1[3-9]\d{9}"),
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("ID_CARD", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"),
    ("BANK_CARD", r"[3-6]\d{15,18}"),
    ("COMPANY", r"[一-龥]{2,20}(?:有限公司|股份有限公司|集团|公司)"),
    ("BANK_NAME", r"[一-龥]{2,10}(?:银行)[一-龥]{0,10}(?:分行|支行|营业部)?"),
    ("ACCOUNT_NUMBER", r"(?:账号|帐号|账户号)[：:\s]*(\d{10,25})"),
    ("DATE", r"(?:\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?)|(?:\d{4}年\d{1,2}月\d{1,2}日)"),
]

# Label of a type in smart replacements.
LABELS = {
    "PERSON": "当事人", "ID_CARD": "证件号", "PASSPORT": "护照号", "PHONE": "电话", "EMAIL": "邮箱", "BANK_CARD": "账号",
    "BANK_ACCOUNT": "银行账号", "BANK_NAME": "开户行", "SOCIAL_SECURITY": "社保号", "WECHAT_ALIPAY": "支付账号", "IP_ADDRESS": "IP地址",
    "MAC_ADDRESS": "MAC地址", "DEVICE_ID": "设备号", "BIOMETRIC": "生物特征", "LEGAL_PARTY": "当事人", "LAWYER": "律师", "JUDGE": "法官",
    "WITNESS": "证人", "ORG": "公司", "COMPANY": "公司", "ADDRESS": "地址", "BIRTH_DATE": "出生日期", "DATE": "日期", "LICENSE_PLATE": "车牌",
    "CASE_NUMBER": "案号", "CONTRACT_NO": "合同编号", "COMPANY_CODE": "信用代码", "VIN": "车架号", "AMOUNT": "金额", "MONEY": "金额",
    "HEALTH_INFO": "健康信息", "MEDICAL_RECORD": "病历号", "PROPERTY": "财产", "CRIMINAL_RECORD": "犯罪记录", "CUSTOM": "敏感信息",
}
DEFAULT_LABEL = "敏感信息"
NUMERALS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]

# Names that a model gives to types; the first name of an id is the one it is asked by.
ALIASES = {
    "PERSON": ["人名", "姓名", "名字", "账户名", "户名"],
    "ID_CARD": ["身份证号", "身份证", "身份证号码"],
    "PASSPORT": ["护照号", "护照", "护照号码"],
    "PHONE": ["电话号码", "电话", "手机号", "联系方式", "手机"],
    "EMAIL": ["电子邮箱", "邮箱", "邮件"],
    "BANK_CARD": ["银行卡号", "银行卡", "卡号"],
    "BANK_ACCOUNT": ["银行账号", "账号", "账户号", "账户号码"],
    "BANK_NAME": ["开户行", "开户银行", "银行名称", "银行"],
    "SOCIAL_SECURITY": ["社保号", "社保卡号", "医保号"],
    "COMPANY": ["公司名称", "公司", "公司名", "企业", "企业名称", "甲方", "乙方", "丙方", "发包方", "承包方", "出借人", "借款人", "出卖人", "买受人", "委托方", "受托方", "供应商", "承揽方", "转让方", "受让方"],
    "ORG": ["组织", "机构名称", "组织机构", "机构", "单位"],
    "ADDRESS": ["地址", "详细地址", "住址", "居住地"],
    "BIRTH_DATE": ["出生日期", "生日"],
    "DATE": ["日期", "时间", "日期时间"],
    "LICENSE_PLATE": ["车牌号", "车牌"],
    "CASE_NUMBER": ["案件编号", "案号"],
    "CONTRACT_NO": ["合同编号", "合同号"],
    "COMPANY_CODE": ["统一社会信用代码", "信用代码"],
    "AMOUNT": ["金额", "数额", "款项"],
    "LEGAL_PARTY": ["当事人", "原告", "被告"],
    "LAWYER": ["律师", "代理人"],
    "JUDGE": ["法官", "审判长", "书记员"],
    "WITNESS": ["证人"],
    "DOCUMENT": ["文件"],
    "PASSWORD": ["密码"],
}

# Category and path of structured tags for types without a template.
STRUCTURED = {
    "PERSON": ("人物", "个人.姓名"), "ORG": ("组织", "企业.完整名称"), "ADDRESS": ("地点", "办公地址.完整地址"), "PHONE": ("电话", "固定电话.号码"),
    "ID_CARD": ("编号", "身份证.号码"), "BANK_CARD": ("编号", "银行卡.号码"), "CASE_NUMBER": ("编号", "案件编号.号码"), "DATE": ("日期/时间", "具体日期.年月日"),
    "MONEY": ("金额", "合同金额.数值"), "AMOUNT": ("金额", "合同金额.数值"), "EMAIL": ("邮箱", "个人邮箱.地址"), "LICENSE_PLATE": ("编号", "车牌.号码"),
    "CONTRACT_NO": ("编号", "合同编号.代码"),
}
OTHER_PATH = "完整名称"

# The preset types.  id, name, category, risk_level, order, enabled, use_llm, regex_pattern, tag_template.
CATALOG_FIELDS = ["id", "name", "category", "risk_level", "order", "enabled", "use_llm", "regex_pattern", "tag_template"]
CATALOG = [
    ("PERSON", "姓名", "direct", 5, 1, True, True, None, "<姓名[{index}].自然人.全名>"),
    ("ID_CARD", "身份证号", "direct", 5, 2, True, False, r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", "<证件号码[{index}].身份证.号码>"),
    ("PASSPORT", "护照号", "direct", 5, 3, True, False, r"[EeGgCc][A-Za-z]?\d{7,8}", "<证件号码[{index}].护照.号码>"),
    ("SOCIAL_SECURITY", "社保号/医保号", "direct", 5, 4, True, True, None, "<证件号码[{index}].社保卡.号码>"),
    ("DRIVER_LICENSE", "驾驶证号/行驶证号", "direct", 5, 5, True, True, None, "<证件号码[{index}].驾驶证.号码>"),
    ("MILITARY_ID", "军官证/士兵证号", "direct", 5, 5, False, True, None, "<证件号码[{index}].军人证件.号码>"),
    ("PHONE", "电话号码", "direct", 5, 6, True, False, r"(?:\+86[-\s]?)?1[3-9]\d{9}|(?:0\d{2,3}[-\s]?)?\d{7,8}|400[-\s]?\d{3,4}[-\s]?\d{4}", "<联系方式[{index}].电话.号码>"),
    ("EMAIL", "电子邮箱", "direct", 4, 7, True, False, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}", "<联系方式[{index}].邮箱.地址>"),
    ("QQ_WECHAT_ID", "QQ号/微信号", "direct", 4, 7, True, True, None, "<联系方式[{index}].社交账号.ID>"),
    ("BANK_CARD", "银行卡号", "direct", 5, 8, True, False, r"(?:62|4|5)\d{14,17}", "<金融账户[{index}].银行卡.号码>"),
    ("BANK_ACCOUNT", "银行账号", "direct", 5, 9, True, True, None, "<金融账户[{index}].银行账号.号码>"),
    ("BANK_NAME", "开户行/银行名称", "direct", 4, 9, True, True, None, "<金融账户[{index}].开户行.名称>"),
    ("PAYMENT_ACCOUNT", "支付账号", "direct", 4, 10, True, True, None, "<金融账户[{index}].支付账号.账号>"),
    ("TAX_ID", "纳税人识别号", "direct", 4, 10, True, True, None, "<金融账户[{index}].税号.号码>"),
    ("IP_ADDRESS", "IP地址", "direct", 4, 11, True, False, r"(?:\d{1,3}\.){3}\d{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", "<网络标识[{index}].IP地址.地址>"),
    ("MAC_ADDRESS", "MAC地址", "direct", 4, 12, True, False, "(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", "<网络标识[{index}].MAC地址.地址>"),
    ("DEVICE_ID", "设备标识", "direct", 4, 13, True, True, None, "<网络标识[{index}].设备ID.标识>"),
    ("BIOMETRIC", "生物特征", "direct", 5, 14, True, True, None, "<生物特征[{index}].类型.标识>"),
    ("USERNAME_PASSWORD", "用户名/密码", "direct", 5, 15, True, True, None, "<认证凭据[{index}].类型.内容>"),
    ("BIRTH_DATE", "出生日期", "quasi", 3, 20, True, True, r"(?:出生[于日期：:]*|生日[：:]*)?\d{4}[-年/]\d{1,2}[-月/]\d{1,2}[日]?", "<人口统计[{index}].出生日期.日期>"),
    ("AGE", "年龄", "quasi", 2, 21, True, True, None, "<人口统计[{index}].年龄.数值>"),
    ("GENDER", "性别", "quasi", 1, 22, True, True, None, "<人口统计[{index}].性别.类型>"),
    ("NATIONALITY", "国籍/民族", "quasi", 2, 23, True, True, None, "<人口统计[{index}].国籍民族.类型>"),
    ("MARITAL_STATUS", "婚姻状况", "quasi", 2, 23, False, True, None, "<人口统计[{index}].婚姻状况.类型>"),
    ("ADDRESS", "详细地址", "quasi", 4, 24, True, True, None, "<地理位置[{index}].详细地址.完整地址>"),
    ("POSTAL_CODE", "邮政编码", "quasi", 2, 25, True, False, r"(?:邮编[：:]*)?\d{6}", "<地理位置[{index}].邮编.编码>"),
    ("GPS_LOCATION", "GPS坐标", "quasi", 3, 26, True, True, r"[\d.]+°?\s*[NS]?,?\s*[\d.]+°?\s*[EW]?|[经纬]度[：:]\s*[\d.]+", "<地理位置[{index}].GPS坐标.坐标>"),
    ("OCCUPATION", "职业/职务", "quasi", 2, 27, True, True, None, "<职业教育[{index}].职业.名称>"),
    ("EDUCATION", "教育背景", "quasi", 2, 28, True, True, None, "<职业教育[{index}].学历.类型>"),
    ("WORK_UNIT", "工作单位", "quasi", 3, 29, True, True, None, "<职业教育[{index}].单位.名称>"),
    ("DATE", "日期", "quasi", 2, 30, True, False, r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}", "<时间信息[{index}].日期.年月日>"),
    ("TIME", "时间", "quasi", 1, 31, True, True, r"\d{1,2}[:：]\d{2}(?:[:：]\d{2})?|[上下]午\d{1,2}[点时]\d{0,2}分?", "<时间信息[{index}].时刻.时分>"),
    ("LICENSE_PLATE", "车牌号", "quasi", 3, 32, True, False, "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5,6}", "<车辆信息[{index}].车牌.号码>"),
    ("VIN", "车架号/VIN", "quasi", 3, 33, True, True, "[A-HJ-NPR-Z0-9]{17}", "<车辆信息[{index}].车架号.号码>"),
    ("HEALTH_INFO", "健康/医疗信息", "sensitive", 4, 40, True, True, None, "<敏感信息[{index}].健康.描述>"),
    ("MEDICAL_RECORD", "病历号/就诊号", "sensitive", 4, 41, True, True, None, "<敏感信息[{index}].病历号.号码>"),
    ("AMOUNT", "金额/财务数据", "sensitive", 3, 42, True, True, None, "<财务信息[{index}].金额.数值>"),
    ("PROPERTY", "财产/资产信息", "sensitive", 3, 43, True, True, None, "<财务信息[{index}].财产.描述>"),
    ("CRIMINAL_RECORD", "犯罪/违法记录", "sensitive", 5, 44, True, True, None, "<敏感信息[{index}].犯罪记录.描述>"),
    ("POLITICAL", "政治面貌", "sensitive", 3, 45, True, True, None, "<敏感信息[{index}].政治面貌.类型>"),
    ("RELIGION", "宗教信仰", "sensitive", 3, 46, True, True, None, "<敏感信息[{index}].宗教信仰.类型>"),
    ("SEXUAL_ORIENTATION", "性取向/性别认同", "sensitive", 5, 47, False, True, None, "<敏感信息[{index}].性取向.类型>"),
    ("CASE_NUMBER", "案件编号", "quasi", 3, 50, True, False, r"[\(（]\d{4}[\)）][京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领A-Za-z]{1,4}\d{0,4}[民刑行执破知赔财商劳仲][初终复再抗申裁监督撤]?\d+号", "<案件信息[{index}].案号.编号>"),
    ("CONTRACT_NO", "合同/协议编号", "quasi", 2, 51, True, True, None, "<法律文书[{index}].合同编号.代码>"),
    ("LEGAL_DOC_NO", "法律文书编号", "quasi", 2, 51, True, True, None, "<法律文书[{index}].文书编号.编号>"),
    ("LEGAL_PARTY", "案件当事人", "direct", 5, 52, True, True, None, "<诉讼参与人[{index}].当事人.姓名>"),
    ("LAWYER", "律师/代理人", "direct", 4, 53, True, True, None, "<诉讼参与人[{index}].律师.姓名>"),
    ("JUDGE", "法官/书记员", "direct", 4, 54, True, True, None, "<诉讼参与人[{index}].司法人员.姓名>"),
    ("WITNESS", "证人/鉴定人", "direct", 4, 55, True, True, None, "<诉讼参与人[{index}].证人.姓名>"),
    ("ORG", "机构/单位名称", "quasi", 3, 56, True, True, None, "<机构信息[{index}].名称.全称>"),
    ("COMPANY_CODE", "统一社会信用代码", "quasi", 3, 57, True, True, "[0-9A-Z]{18}", "<机构信息[{index}].信用代码.编号>"),
    ("URL_WEBSITE", "网址/链接", "quasi", 2, 58, True, False, r'https?://[^\s<>"{}|\\^`\[\]]+', "<网络信息[{index}].网址.URL>"),
]

# File kinds by extension, and signatures with the extensions they stand for (in this order).
FILE_TYPES = {"doc": [".doc"], "docx": [".docx"], "txt": [".txt", ".md", ".rtf", ".html", ".htm"], "pdf": [".pdf"], "image": [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff"]}
SIGNATURES = [
    (b"%PDF", [".pdf"]),
    (b"PK\x03\x04", [".docx", ".doc"]),
    (b"\xff\xd8\xff", [".jpg", ".jpeg"]),
    (b"\x89PNG", [".png"]),
    (b"GIF8", [".gif"]),
    (b"BM", [".bmp"]),
    (b"RIFF", [".webp"]),
    (b"\xd0\xcf\x11\xe0", [".doc", ".rtf"]),
    (b"II*\x00", [".tif", ".tiff"]),
    (b"MM\x00*", [".tif", ".tiff"]),
    (b"{\\rtf", [".rtf"]),
]

# States and which may follow which; "*" is any state.
JOB_STATES = ["draft", "queued", "processing", "awaiting_review", "completed", "failed", "cancelled", "running", "redacting"]
ITEM_STATES = ["pending", "processing", "awaiting_review", "completed", "failed", "queued", "parsing", "ner", "vision", "review_approved", "redacting", "cancelled"]
JOB_EDGES = {
    "draft": ["queued", "processing", "cancelled"],
    "queued": ["processing", "cancelled"],
    "processing": ["awaiting_review", "completed", "failed", "cancelled"],
    "awaiting_review": ["processing", "completed", "failed", "cancelled"],
    "completed": ["queued"],
    "failed": ["queued", "processing", "cancelled"],
    "cancelled": [],
    "running": ["*"],
    "redacting": ["*"],
}
ITEM_EDGES = {
    "pending": ["processing", "awaiting_review", "cancelled"],
    "processing": ["awaiting_review", "completed", "failed"],
    "awaiting_review": ["processing", "completed", "failed"],
    "completed": [],
    "failed": ["pending", "processing"],
    "queued": ["*"],
    "parsing": ["*"],
    "ner": ["*"],
    "vision": ["*"],
    "review_approved": ["*"],
    "redacting": ["*"],
    "cancelled": [],
}

# Classes of the image detector, by number from 0.
IMAGE_CLASSES = ["face", "fingerprint", "palmprint", "id_card", "hk_macau_permit", "passport", "employee_badge", "license_plate", "bank_card", "physical_key", "receipt", "shipping_label", "official_seal", "whiteboard", "sticky_note", "mobile_screen", "monitor_screen", "medical_wristband", "qr_code", "barcode", "paper"]

# Types that are looked for in the text of an image (id, name, order), and names of the image detector's classes.
OCR_TYPES = [
    ("PERSON", "姓名", 1),
    ("ID_CARD", "身份证号", 2),
    ("PASSPORT", "护照号/通行证", 3),
    ("PHONE", "电话号码", 4),
    ("EMAIL", "电子邮箱", 5),
    ("BANK_CARD", "银行卡号", 6),
    ("BANK_ACCOUNT", "银行账号", 7),
    ("BANK_NAME", "开户行/银行名称", 7),
    ("SOCIAL_SECURITY", "社保号/公积金号", 8),
    ("QQ_WECHAT_ID", "社交账号", 9),
    ("COMPANY", "公司/企业名称", 10),
    ("ORG", "机构/单位名称", 11),
    ("ADDRESS", "详细地址", 11),
    ("BIRTH_DATE", "出生日期", 12),
    ("DATE", "日期/时间", 13),
    ("LICENSE_PLATE", "车牌号", 14),
    ("CASE_NUMBER", "案件编号", 15),
    ("CONTRACT_NO", "合同/文书编号", 16),
    ("COMPANY_CODE", "信用代码/注册号", 17),
    ("AMOUNT", "金额/财务数据", 20),
    ("PROPERTY", "财产/资产", 21),
    ("LEGAL_PARTY", "当事人", 30),
    ("LAWYER", "律师/代理人", 31),
    ("JUDGE", "法官/书记员", 32),
    ("WITNESS", "证人/鉴定人", 33),
    ("SEAL", "印章/公章", 90),
]
IMAGE_NAMES = ["人脸", "指纹", "掌纹", "身份证", "港澳通行证", "护照", "工作证", "车牌", "银行卡", "钥匙", "小票/收据", "快递面单", "公章", "白板", "便利贴", "手机屏幕", "电脑屏幕", "医用腕带", "二维码", "条形码", "纸质文档"]
IMAGE_TYPES = list(zip(IMAGE_CLASSES, IMAGE_NAMES))


def catalog() -> list[dict]:
    return [dict(zip(CATALOG_FIELDS, row)) for row in CATALOG]
