"""Fixed values of the detection domain: labels, rules, word lists, dimensions.

Everything in this module is data that decides results and therefore has to have
exactly these values; no logic is kept here.
"""

from __future__ import annotations

# Kinds of personal data, in order, with their Japanese and English names.
PII_TYPES = (
    ("NAME", "氏名", "Name"),
    ("ADDRESS", "住所", "Address"),
    ("PHONE", "電話番号", "Phone"),
    ("EMAIL", "メールアドレス", "Email"),
    ("DOB", "生年月日", "Date of birth"),
    ("BANK_ACCOUNT", "口座番号", "Bank account"),
    ("CREDIT_CARD", "クレジットカード番号", "Credit card"),
    ("MYNUMBER", "マイナンバー", "MyNumber"),
    ("MEMBER_ID", "会員番号", "Member ID"),
    ("POSTAL_CODE", "郵便番号", "Postal code"),
)
LABELS = tuple(t[0] for t in PII_TYPES)
MODEL_DRIVEN = ("NAME", "ADDRESS", "DOB")
RULE_DETERMINISTIC = tuple(label for label in LABELS if label not in MODEL_DRIVEN)

# Boundaries of digit shapes, context words and negative context words of the rules.
NOT_BEFORE = r"(?<![0-9A-Za-z\-])"
NOT_AFTER = r"(?![0-9A-Za-z\-])"
PHONE_WORDS = ("TEL", "Tel", "tel", "電話", "でんわ", "連絡先", "携帯", "FAX", "Fax", "お電話", "番号", "ご連絡", "直通", "代表")
PHONE_NEGATIVE = (
    "型番", "製品コード", "注文番号", "整理番号", "追跡番号", "ISBN", "図面番号", "会議室", "在庫コード", "試験区分",
    "バージョン", "郵便物番号", "測定値", "商品コード", "管理番号", "伝票",
)
MYNUMBER_NEGATIVE = (
    "追跡番号", "郵便物番号", "注文番号", "型番", "整理番号", "伝票", "管理番号", "在庫", "図面番号", "試験区分",
    "製品コード", "商品コード", "会議室", "ISBN",
)
POSTAL_WORDS = ("〒", "郵便番号", "住所", "所在地", "送付先", "ご住所")
BANK_WORDS = ("口座", "振込", "支店", "普通", "当座", "引落", "銀行")
MYNUMBER_WORDS = ("マイナンバー", "個人番号", "通知カード", "本人確認", "マイナ")
MEMBER_WORDS = (
    "会員番号", "顧客番号", "契約番号", "受付番号", "お客様番号", "整理番号", "会員ID", "顧客ID", "社員番号",
    "登録番号", "カード番号",
)
MEMBER_NUMERIC_WORDS = ("会員番号", "顧客番号", "契約番号", "お客様番号", "社員番号", "会員ID")

# Fixed values: (rule_id, label, pattern, confidence, context required, priority, context, negative context, validator).
RULES = (
    ("email.basic", "EMAIL",
     r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
     r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?)+",
     0.99, False, 90, (), (), None),
    ("phone.jp", "PHONE",
     NOT_BEFORE + r"(?:\+81[\-\s]?)?0\d{1,4}[\-\(\)\s]?\d{1,4}[\-\)\s]?\d{3,4}" + NOT_AFTER,
     0.80, False, 80, PHONE_WORDS, PHONE_NEGATIVE, "jp_phone"),
    ("postal.jp", "POSTAL_CODE", NOT_BEFORE + r"\d{3}-\d{4}" + NOT_AFTER, 0.55, True, 70, POSTAL_WORDS, (), None),
    ("bank.code_branch_account", "BANK_ACCOUNT", NOT_BEFORE + r"\d{4}-\d{3}-\d{7}" + NOT_AFTER,
     0.95, False, 85, BANK_WORDS, (), None),
    ("bank.prose", "BANK_ACCOUNT", r"(?:普通|当座|貯蓄)\s*(?:預金)?\s*" + NOT_BEFORE + r"\d{7}" + NOT_AFTER,
     0.92, False, 84, (), (), None),
    ("card.16digit", "CREDIT_CARD", NOT_BEFORE + r"(?:\d{4}[\-\s]\d{4}[\-\s]\d{4}[\-\s]\d{4}|\d{16})" + NOT_AFTER,
     0.93, False, 88, (), (), None),
    ("card.amex", "CREDIT_CARD", NOT_BEFORE + r"3[47]\d{2}[\-\s]\d{6}[\-\s]\d{5}" + NOT_AFTER,
     0.93, False, 88, (), (), None),
    ("mynumber.12digit", "MYNUMBER", NOT_BEFORE + r"(?:\d{4}[\-\s]\d{4}[\-\s]\d{4}|\d{12})" + NOT_AFTER,
     0.70, True, 86, MYNUMBER_WORDS, MYNUMBER_NEGATIVE, None),
    ("member.prefixed", "MEMBER_ID", r"(?<![A-Za-z0-9])[A-Z]{2,6}[\-]?\d{4,12}(?:[\-]\d{2,6})?(?![A-Za-z0-9])",
     0.60, True, 60, MEMBER_WORDS, (), None),
    ("member.numeric_ctx", "MEMBER_ID", NOT_BEFORE + r"\d{6,12}(?:-\d{2,6})?" + NOT_AFTER,
     0.55, True, 55, MEMBER_NUMERIC_WORDS, (), None),
)

# Added for a context word, highest score, characters of context on either side.
CONTEXT_BONUS, SCORE_CAP, CONTEXT_CHARS = 0.15, 0.99, 12

# Boundary refinement of names and addresses, longest first.
HONORIFICS = ("先生", "部長", "課長", "社長", "ちゃん", "様", "さん", "氏", "殿", "君")
PARTICLES = ("より", "から", "は", "が", "の", "を", "に", "へ", "と", "で", "も")
TRIM_CHARS = " \t\n　、。，．,.:：;；・「」『』（）()[]［］{}｛｝【】〈〉《》!?！？…\"'“”‘’-–—/／|｜*＊#＃@＠&＆+＋=＝_＿"
REFINED_LABELS = ("NAME", "ADDRESS")

# Kinds of hard negatives, and the patterns that tell them by the 24 characters around a false positive.
NEGATIVE_KINDS = (
    "common_noun_surname", "place_as_person", "company_as_person", "honorific_boundary",
    "phone_like_id", "address_like_facility", "number_like_id", "date_like_nondob",
)
KIND_PATTERNS = (
    ("phone_like_id", "型番|製品コード|注文番号|整理番号|ISBN|追跡番号|図面番号|会議室|バージョン|在庫コード|試験区分|測定値|郵便物番号"),
    ("date_like_nondob", "契約日|次回会議|発行日|着工|施行|納品期限|有効期限|株主総会|説明会|時点の残高|受付開始|解散"),
    ("number_like_id", "議案第|法律第|売上高|座席番号|予算額|定例会|統計表|在庫数量|延べ|標高|投票総数|欠番"),
    ("address_like_facility", "センター|区役所|市役所|県庁|庁舎|図書館|病院|大学|会館|公園|ターミナル|体育館|博物館|警察|フォーラム|倉庫|時計台|事務所|駅"),
    ("company_as_person", "株式会社|工業|商事|製作所|製菓|製パン|建設|重工|物産|証券|建機|ホールディングス|工務店|コンストラクション|ハウス|電器|貴金属"),
    ("honorific_boundary", "各位|皆様|お客様|神様|王様|奥様|御中|担当者様|先方様|殿様|様式|同様|多様|仕様|模様|御中元|氏名欄|氏族|君主|諸君|先生方|衛生|部長会議|課長職|社長就任"),
    ("place_as_person", "県|市内|支店|県産|方面|地方|移転|復興"),
)
CONTEXT_OF_KIND = 24
NOUN_SURNAMES = (
    "森", "林", "泉", "大和", "青木", "石田", "原", "谷", "島", "川", "本田", "東", "西", "南", "北", "上田", "小島", "松", "藤", "柳",
    "岩", "辻", "堀", "関", "高", "新井", "花田",
)

# Labels of other detectors and the kinds they stand for.
GINZA_LABELS = (
    ("Person", "NAME"), ("Character", "NAME"), ("Address", "ADDRESS"), ("Postal_Address", "ADDRESS"),
    ("Province", "ADDRESS"), ("City", "ADDRESS"), ("County", "ADDRESS"), ("Country", "ADDRESS"),
    ("GPE_Other", "ADDRESS"), ("Region_Other", "ADDRESS"), ("Geological_Region_Other", "ADDRESS"),
    ("Continental_Region", "ADDRESS"), ("Domestic_Region", "ADDRESS"), ("Date", "DOB"), ("Era", "DOB"),
    ("Phone_Number", "PHONE"), ("Email", "EMAIL"), ("Postal_Code", "POSTAL_CODE"), ("ID_Number", "MEMBER_ID"),
)
PRESIDIO_LABELS = (
    ("PERSON", "NAME"), ("LOCATION", "ADDRESS"), ("GPE", "ADDRESS"), ("NRP", "NAME"), ("PHONE_NUMBER", "PHONE"),
    ("EMAIL_ADDRESS", "EMAIL"), ("DATE_TIME", "DOB"), ("CREDIT_CARD", "CREDIT_CARD"), ("IBAN_CODE", "BANK_ACCOUNT"),
    ("US_BANK_NUMBER", "BANK_ACCOUNT"), ("US_SSN", "MYNUMBER"),
)
ENTITY_OF_LABEL = (
    ("NAME", "PERSON"), ("ADDRESS", "LOCATION"), ("PHONE", "PHONE_NUMBER"), ("EMAIL", "EMAIL_ADDRESS"), ("DOB", "DATE_TIME"),
    ("CREDIT_CARD", "CREDIT_CARD"), ("BANK_ACCOUNT", "JP_BANK_ACCOUNT"), ("MYNUMBER", "JP_MY_NUMBER"),
    ("MEMBER_ID", "JP_MEMBER_ID"), ("POSTAL_CODE", "JP_POSTAL_CODE"),
)
ADDRESS_PARTS = (
    "Address", "Postal_Address", "Province", "City", "County", "Country", "GPE_Other", "Region_Other", "Domestic_Region",
)
BLOCK_NUMBER = r"^[\s　]*((?:\d+[-\d]*)|(?:[一二三四五六七八九十]+丁目[\d一二三四五六七八九十番地号\-]*))"

# Eras with their first day.
ERAS = (
    ("明治", "1868-10-23"), ("大正", "1912-07-30"), ("昭和", "1926-12-25"), ("平成", "1989-01-08"), ("令和", "2019-05-01"),
)

# What makes a chunk of a corpus usable.
MIN_CHUNK, MAX_CHUNK, MIN_JA_CHARS, MIN_JA_RATIO, MAX_MARKUP_RATIO = 120, 600, 40, 0.30, 0.04

# Placeholder styles, least length of a guarded value, least digits and share of digits of a number.
STYLES = {"angle": ("<", ">"), "square": ("[", "]"), "brace": ("{{", "}}")}
PLACEHOLDER = r"<[A-Z_]+_\d+>|\[[A-Z_]+_\d+\]|\{\{[A-Z_]+_\d+\}\}"
GUARD_MIN_CHARS, GUARD_MIN_DIGITS, GUARD_DIGIT_SHARE = 3, 7, 0.6

# Words in the type names of a language model's answer, in the order they are tried.
ANSWER_TYPES = (
    ("氏名", "NAME"), ("人名", "NAME"), ("名前", "NAME"), ("住所", "ADDRESS"), ("電話番号", "PHONE"), ("電話", "PHONE"),
    ("メールアドレス", "EMAIL"), ("メール", "EMAIL"), ("生年月日", "DOB"), ("金融口座", "BANK_ACCOUNT"), ("口座", "BANK_ACCOUNT"),
    ("口座番号", "BANK_ACCOUNT"), ("カード番号", "CREDIT_CARD"), ("クレジットカード", "CREDIT_CARD"), ("マイナンバー", "MYNUMBER"),
    ("個人番号", "MYNUMBER"), ("会員番号", "MEMBER_ID"), ("顧客番号", "MEMBER_ID"), ("郵便番号", "POSTAL_CODE"),
)

# Places that are also surnames.
PLACE_SURNAMES = (
    "長野", "福島", "千葉", "山口", "宮崎", "石川", "岡山", "福井", "山形", "徳島", "香川", "大分", "佐賀", "奈良",
    "三重", "滋賀", "愛媛", "高知",
)
