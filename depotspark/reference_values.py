"""Fixed values that results depend on: word lists, codes, patterns and limits of the warehouse domain."""

# Null tokens, units, patterns and limits of the cleaning rules.
NULL_TOKENS = ["", "NULL", "N/A", "NA", "NONE", "-"]
UNITS = ["個", "箱", "包", "PCS", "盒", "瓶", "桶", "條", "組", "袋", "捲", "板", "件", "支", "公斤"]
SHIP_NO = r"^OU[0-9]{8}[0-9]{6}$"
MIN_NAME_LETTERS = 2
# Patterns of addresses; digits are those of any script.
POSTAL = r"^\(?\p{Nd}{3,6}\)?[\s,，、\-]*"
ROAD = "([一-鿿]{1,10}?(?:大道|大街|路|街|道))"
SECTION = r"[一二三四五六七八九十\p{Nd}]+段$"
VILLAGE = "^([一-鿿]{1,8}?[村里])"
OLD_TOWN = r"^([^\s\p{Nd}]{1,3}?)(市|鎮|鄉)"
DISTRICT = r"[^\s\p{Nd}]{1,4}?(?:市|鎮|鄉|區)"
# Limits of the cleaning rules.
TEST_CATEGORIES = [81, 82]
EXTREME_MAX = {"len_cm": 200.0, "wid_cm": 200.0, "hgt_cm": 200.0, "weight_kg": 30.0}
UNIT_FACTORS = [10, 100, 1000]
PLAUSIBLE_RATIO = 3.0
MIN_CATEGORY_ROWS = 5
MIN_CATEGORY_ITEMS = 3
EXTREME_VOLUME = 500_000.0
SHARED_VALUE_ITEMS = 10
SHELF_MAX_VOLUME = 50_000.0
SHELF_MAX_EDGE = 60.0
SHARED_ADDRESS_STORES = 5
SHARED_ADDRESS_ROWS = 3

# Cities, old counties, abbreviations and special district names.
CITIES = ["台北市", "臺北市", "新北市", "桃園市", "台中市", "臺中市", "台南市", "臺南市", "高雄市", "基隆市", "新竹市", "新竹縣", "嘉義市", "嘉義縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "屏東縣", "宜蘭縣", "花蓮縣", "台東縣", "臺東縣", "澎湖縣", "金門縣", "連江縣"]
OLD_COUNTIES = {"台北縣": "新北市", "臺北縣": "新北市", "高雄縣": "高雄市", "台南縣": "台南市", "臺南縣": "台南市", "台中縣": "台中市", "臺中縣": "台中市", "桃園縣": "桃園市"}
OLD_COUNTY_ABBREVIATIONS = {"北縣": "台北縣", "高縣": "高雄縣", "南縣": "台南縣", "中縣": "台中縣", "桃縣": "桃園縣"}
CITY_ABBREVIATIONS = {"北市": "台北市", "新北": "新北市", "桃市": "桃園市", "中市": "台中市", "南市": "台南市", "高市": "高雄市", "竹市": "新竹市", "竹縣": "新竹縣", "苗縣": "苗栗縣", "投縣": "南投縣", "雲縣": "雲林縣", "嘉市": "嘉義市", "嘉縣": "嘉義縣", "屏縣": "屏東縣", "宜縣": "宜蘭縣", "花縣": "花蓮縣", "東縣": "台東縣", "澎縣": "澎湖縣", "金縣": "金門縣", "連縣": "連江縣"}
SPECIAL_DISTRICTS = ["前鎮區", "平鎮區", "左鎮區"]
RENAMED_TOWNSHIPS = {"三民鄉": "那瑪夏區"}

# Townships whose name is unique in the country, as (township, county).
TOWNSHIPS = [
    ("竹北市", "新竹縣"),
    ("竹東鎮", "新竹縣"),
    ("新埔鎮", "新竹縣"),
    ("關西鎮", "新竹縣"),
    ("湖口鄉", "新竹縣"),
    ("新豐鄉", "新竹縣"),
    ("芎林鄉", "新竹縣"),
    ("橫山鄉", "新竹縣"),
    ("北埔鄉", "新竹縣"),
    ("寶山鄉", "新竹縣"),
    ("峨眉鄉", "新竹縣"),
    ("尖石鄉", "新竹縣"),
    ("五峰鄉", "新竹縣"),
    ("苗栗市", "苗栗縣"),
    ("頭份市", "苗栗縣"),
    ("苑裡鎮", "苗栗縣"),
    ("通霄鎮", "苗栗縣"),
    ("竹南鎮", "苗栗縣"),
    ("後龍鎮", "苗栗縣"),
    ("卓蘭鎮", "苗栗縣"),
    ("大湖鄉", "苗栗縣"),
    ("公館鄉", "苗栗縣"),
    ("銅鑼鄉", "苗栗縣"),
    ("南庄鄉", "苗栗縣"),
    ("頭屋鄉", "苗栗縣"),
    ("三義鄉", "苗栗縣"),
    ("西湖鄉", "苗栗縣"),
    ("造橋鄉", "苗栗縣"),
    ("三灣鄉", "苗栗縣"),
    ("獅潭鄉", "苗栗縣"),
    ("泰安鄉", "苗栗縣"),
    ("彰化市", "彰化縣"),
    ("鹿港鎮", "彰化縣"),
    ("和美鎮", "彰化縣"),
    ("線西鄉", "彰化縣"),
    ("伸港鄉", "彰化縣"),
    ("福興鄉", "彰化縣"),
    ("秀水鄉", "彰化縣"),
    ("花壇鄉", "彰化縣"),
    ("芬園鄉", "彰化縣"),
    ("員林市", "彰化縣"),
    ("溪湖鎮", "彰化縣"),
    ("田中鎮", "彰化縣"),
    ("大村鄉", "彰化縣"),
    ("埔鹽鄉", "彰化縣"),
    ("埔心鄉", "彰化縣"),
    ("永靖鄉", "彰化縣"),
    ("社頭鄉", "彰化縣"),
    ("二水鄉", "彰化縣"),
    ("北斗鎮", "彰化縣"),
    ("二林鎮", "彰化縣"),
    ("田尾鄉", "彰化縣"),
    ("埤頭鄉", "彰化縣"),
    ("芳苑鄉", "彰化縣"),
    ("大城鄉", "彰化縣"),
    ("竹塘鄉", "彰化縣"),
    ("溪州鄉", "彰化縣"),
    ("南投市", "南投縣"),
    ("埔里鎮", "南投縣"),
    ("草屯鎮", "南投縣"),
    ("竹山鎮", "南投縣"),
    ("集集鎮", "南投縣"),
    ("名間鄉", "南投縣"),
    ("鹿谷鄉", "南投縣"),
    ("中寮鄉", "南投縣"),
    ("魚池鄉", "南投縣"),
    ("國姓鄉", "南投縣"),
    ("水里鄉", "南投縣"),
    ("信義鄉", "南投縣"),
    ("仁愛鄉", "南投縣"),
    ("斗六市", "雲林縣"),
    ("斗南鎮", "雲林縣"),
    ("虎尾鎮", "雲林縣"),
    ("西螺鎮", "雲林縣"),
    ("土庫鎮", "雲林縣"),
    ("北港鎮", "雲林縣"),
    ("古坑鄉", "雲林縣"),
    ("大埤鄉", "雲林縣"),
    ("莿桐鄉", "雲林縣"),
    ("林內鄉", "雲林縣"),
    ("二崙鄉", "雲林縣"),
    ("崙背鄉", "雲林縣"),
    ("麥寮鄉", "雲林縣"),
    ("東勢鄉", "雲林縣"),
    ("褒忠鄉", "雲林縣"),
    ("台西鄉", "雲林縣"),
    ("元長鄉", "雲林縣"),
    ("四湖鄉", "雲林縣"),
    ("口湖鄉", "雲林縣"),
    ("水林鄉", "雲林縣"),
    ("太保市", "嘉義縣"),
    ("朴子市", "嘉義縣"),
    ("布袋鎮", "嘉義縣"),
    ("大林鎮", "嘉義縣"),
    ("民雄鄉", "嘉義縣"),
    ("溪口鄉", "嘉義縣"),
    ("新港鄉", "嘉義縣"),
    ("六腳鄉", "嘉義縣"),
    ("東石鄉", "嘉義縣"),
    ("義竹鄉", "嘉義縣"),
    ("鹿草鄉", "嘉義縣"),
    ("水上鄉", "嘉義縣"),
    ("中埔鄉", "嘉義縣"),
    ("竹崎鄉", "嘉義縣"),
    ("梅山鄉", "嘉義縣"),
    ("番路鄉", "嘉義縣"),
    ("大埔鄉", "嘉義縣"),
    ("阿里山鄉", "嘉義縣"),
    ("屏東市", "屏東縣"),
    ("潮州鎮", "屏東縣"),
    ("東港鎮", "屏東縣"),
    ("恆春鎮", "屏東縣"),
    ("萬丹鄉", "屏東縣"),
    ("長治鄉", "屏東縣"),
    ("麟洛鄉", "屏東縣"),
    ("九如鄉", "屏東縣"),
    ("里港鄉", "屏東縣"),
    ("鹽埔鄉", "屏東縣"),
    ("高樹鄉", "屏東縣"),
    ("萬巒鄉", "屏東縣"),
    ("內埔鄉", "屏東縣"),
    ("竹田鄉", "屏東縣"),
    ("新埤鄉", "屏東縣"),
    ("枋寮鄉", "屏東縣"),
    ("新園鄉", "屏東縣"),
    ("崁頂鄉", "屏東縣"),
    ("林邊鄉", "屏東縣"),
    ("南州鄉", "屏東縣"),
    ("佳冬鄉", "屏東縣"),
    ("琉球鄉", "屏東縣"),
    ("車城鄉", "屏東縣"),
    ("滿州鄉", "屏東縣"),
    ("枋山鄉", "屏東縣"),
    ("三地門鄉", "屏東縣"),
    ("霧台鄉", "屏東縣"),
    ("瑪家鄉", "屏東縣"),
    ("泰武鄉", "屏東縣"),
    ("來義鄉", "屏東縣"),
    ("春日鄉", "屏東縣"),
    ("獅子鄉", "屏東縣"),
    ("牡丹鄉", "屏東縣"),
    ("宜蘭市", "宜蘭縣"),
    ("羅東鎮", "宜蘭縣"),
    ("蘇澳鎮", "宜蘭縣"),
    ("頭城鎮", "宜蘭縣"),
    ("礁溪鄉", "宜蘭縣"),
    ("壯圍鄉", "宜蘭縣"),
    ("員山鄉", "宜蘭縣"),
    ("五結鄉", "宜蘭縣"),
    ("冬山鄉", "宜蘭縣"),
    ("三星鄉", "宜蘭縣"),
    ("大同鄉", "宜蘭縣"),
    ("南澳鄉", "宜蘭縣"),
    ("花蓮市", "花蓮縣"),
    ("鳳林鎮", "花蓮縣"),
    ("玉里鎮", "花蓮縣"),
    ("新城鄉", "花蓮縣"),
    ("吉安鄉", "花蓮縣"),
    ("壽豐鄉", "花蓮縣"),
    ("光復鄉", "花蓮縣"),
    ("豐濱鄉", "花蓮縣"),
    ("瑞穗鄉", "花蓮縣"),
    ("富里鄉", "花蓮縣"),
    ("秀林鄉", "花蓮縣"),
    ("萬榮鄉", "花蓮縣"),
    ("卓溪鄉", "花蓮縣"),
    ("台東市", "台東縣"),
    ("臺東市", "台東縣"),
    ("成功鎮", "台東縣"),
    ("關山鎮", "台東縣"),
    ("卑南鄉", "台東縣"),
    ("大武鄉", "台東縣"),
    ("太麻里鄉", "台東縣"),
    ("東河鄉", "台東縣"),
    ("長濱鄉", "台東縣"),
    ("鹿野鄉", "台東縣"),
    ("池上鄉", "台東縣"),
    ("綠島鄉", "台東縣"),
    ("延平鄉", "台東縣"),
    ("海端鄉", "台東縣"),
    ("達仁鄉", "台東縣"),
    ("金峰鄉", "台東縣"),
    ("蘭嶼鄉", "台東縣"),
    ("馬公市", "澎湖縣"),
    ("湖西鄉", "澎湖縣"),
    ("白沙鄉", "澎湖縣"),
    ("西嶼鄉", "澎湖縣"),
    ("望安鄉", "澎湖縣"),
    ("七美鄉", "澎湖縣"),
    ("金城鎮", "金門縣"),
    ("金湖鎮", "金門縣"),
    ("金沙鎮", "金門縣"),
    ("金寧鄉", "金門縣"),
    ("烈嶼鄉", "金門縣"),
    ("烏坵鄉", "金門縣"),
    ("南竿鄉", "連江縣"),
    ("北竿鄉", "連江縣"),
    ("莒光鄉", "連江縣"),
    ("東引鄉", "連江縣"),
]

# Townships merged into municipalities, as (township, municipality, district).
OLD_TOWNSHIPS = [
    ("鳳山市", "高雄市", "鳳山區"),
    ("岡山鎮", "高雄市", "岡山區"),
    ("旗山鎮", "高雄市", "旗山區"),
    ("美濃鎮", "高雄市", "美濃區"),
    ("林園鄉", "高雄市", "林園區"),
    ("大寮鄉", "高雄市", "大寮區"),
    ("大樹鄉", "高雄市", "大樹區"),
    ("大社鄉", "高雄市", "大社區"),
    ("仁武鄉", "高雄市", "仁武區"),
    ("鳥松鄉", "高雄市", "鳥松區"),
    ("橋頭鄉", "高雄市", "橋頭區"),
    ("燕巢鄉", "高雄市", "燕巢區"),
    ("田寮鄉", "高雄市", "田寮區"),
    ("阿蓮鄉", "高雄市", "阿蓮區"),
    ("路竹鄉", "高雄市", "路竹區"),
    ("湖內鄉", "高雄市", "湖內區"),
    ("茄萣鄉", "高雄市", "茄萣區"),
    ("永安鄉", "高雄市", "永安區"),
    ("彌陀鄉", "高雄市", "彌陀區"),
    ("梓官鄉", "高雄市", "梓官區"),
    ("六龜鄉", "高雄市", "六龜區"),
    ("甲仙鄉", "高雄市", "甲仙區"),
    ("杉林鄉", "高雄市", "杉林區"),
    ("內門鄉", "高雄市", "內門區"),
    ("茂林鄉", "高雄市", "茂林區"),
    ("桃源鄉", "高雄市", "桃源區"),
    ("三民鄉", "高雄市", "那瑪夏區"),
    ("新營市", "台南市", "新營區"),
    ("鹽水鎮", "台南市", "鹽水區"),
    ("白河鎮", "台南市", "白河區"),
    ("柳營鄉", "台南市", "柳營區"),
    ("後壁鄉", "台南市", "後壁區"),
    ("東山鄉", "台南市", "東山區"),
    ("麻豆鎮", "台南市", "麻豆區"),
    ("下營鄉", "台南市", "下營區"),
    ("六甲鄉", "台南市", "六甲區"),
    ("官田鄉", "台南市", "官田區"),
    ("大內鄉", "台南市", "大內區"),
    ("佳里鎮", "台南市", "佳里區"),
    ("學甲鎮", "台南市", "學甲區"),
    ("西港鄉", "台南市", "西港區"),
    ("七股鄉", "台南市", "七股區"),
    ("將軍鄉", "台南市", "將軍區"),
    ("北門鄉", "台南市", "北門區"),
    ("新化鎮", "台南市", "新化區"),
    ("善化鎮", "台南市", "善化區"),
    ("新市鄉", "台南市", "新市區"),
    ("安定鄉", "台南市", "安定區"),
    ("山上鄉", "台南市", "山上區"),
    ("玉井鄉", "台南市", "玉井區"),
    ("楠西鄉", "台南市", "楠西區"),
    ("南化鄉", "台南市", "南化區"),
    ("左鎮鄉", "台南市", "左鎮區"),
    ("仁德鄉", "台南市", "仁德區"),
    ("歸仁鄉", "台南市", "歸仁區"),
    ("關廟鄉", "台南市", "關廟區"),
    ("龍崎鄉", "台南市", "龍崎區"),
    ("永康市", "台南市", "永康區"),
    ("板橋市", "新北市", "板橋區"),
    ("三重市", "新北市", "三重區"),
    ("中和市", "新北市", "中和區"),
    ("永和市", "新北市", "永和區"),
    ("新莊市", "新北市", "新莊區"),
    ("新店市", "新北市", "新店區"),
    ("樹林市", "新北市", "樹林區"),
    ("鶯歌鎮", "新北市", "鶯歌區"),
    ("三峽鎮", "新北市", "三峽區"),
    ("淡水鎮", "新北市", "淡水區"),
    ("汐止市", "新北市", "汐止區"),
    ("瑞芳鎮", "新北市", "瑞芳區"),
    ("土城市", "新北市", "土城區"),
    ("蘆洲市", "新北市", "蘆洲區"),
    ("五股鄉", "新北市", "五股區"),
    ("泰山鄉", "新北市", "泰山區"),
    ("林口鄉", "新北市", "林口區"),
    ("深坑鄉", "新北市", "深坑區"),
    ("石碇鄉", "新北市", "石碇區"),
    ("坪林鄉", "新北市", "坪林區"),
    ("三芝鄉", "新北市", "三芝區"),
    ("石門鄉", "新北市", "石門區"),
    ("八里鄉", "新北市", "八里區"),
    ("平溪鄉", "新北市", "平溪區"),
    ("雙溪鄉", "新北市", "雙溪區"),
    ("貢寮鄉", "新北市", "貢寮區"),
    ("金山鄉", "新北市", "金山區"),
    ("萬里鄉", "新北市", "萬里區"),
    ("烏來鄉", "新北市", "烏來區"),
    ("豐原市", "台中市", "豐原區"),
    ("大里市", "台中市", "大里區"),
    ("太平市", "台中市", "太平區"),
    ("清水鎮", "台中市", "清水區"),
    ("沙鹿鎮", "台中市", "沙鹿區"),
    ("梧棲鎮", "台中市", "梧棲區"),
    ("大甲鎮", "台中市", "大甲區"),
    ("東勢鎮", "台中市", "東勢區"),
    ("后里鄉", "台中市", "后里區"),
    ("神岡鄉", "台中市", "神岡區"),
    ("潭子鄉", "台中市", "潭子區"),
    ("大雅鄉", "台中市", "大雅區"),
    ("新社鄉", "台中市", "新社區"),
    ("石岡鄉", "台中市", "石岡區"),
    ("外埔鄉", "台中市", "外埔區"),
    ("大安鄉", "台中市", "大安區"),
    ("烏日鄉", "台中市", "烏日區"),
    ("大肚鄉", "台中市", "大肚區"),
    ("龍井鄉", "台中市", "龍井區"),
    ("霧峰鄉", "台中市", "霧峰區"),
    ("和平鄉", "台中市", "和平區"),
    ("中壢市", "桃園市", "中壢區"),
    ("平鎮市", "桃園市", "平鎮區"),
    ("楊梅市", "桃園市", "楊梅區"),
    ("大溪鎮", "桃園市", "大溪區"),
    ("蘆竹鄉", "桃園市", "蘆竹區"),
    ("大園鄉", "桃園市", "大園區"),
    ("龜山鄉", "桃園市", "龜山區"),
    ("八德市", "桃園市", "八德區"),
    ("龍潭鄉", "桃園市", "龍潭區"),
    ("新屋鄉", "桃園市", "新屋區"),
    ("觀音鄉", "桃園市", "觀音區"),
    ("復興鄉", "桃園市", "復興區"),
]

# Categories as (id, code, name).
CATEGORIES = [
    (11, "OCM", "手動牙刷"),
    (12, "F&HC", "織品及家用品"),
    (13, "B&R", "刮鬍刀"),
    (14, "FEM", "女性用品"),
    (15, "BABY", "嬰兒用品"),
    (16, "OCP", "電動牙刷"),
    (17, "HAIR", "髮類"),
    (18, "SNCK", "品客"),
    (19, "SKIN", "歐蕾"),
    (20, "PCC", "香皂"),
    (21, "OTHER", "其他"),
    (22, "BATTERY", "電池"),
    (23, "APPL", "百靈"),
    (24, "8BK4", "8BK4醫療文具剪刀"),
    (25, "8AA4", "8AA4家用品"),
    (26, "009", "吸乳器009"),
    (27, "008", "孕產婦和哺乳服裝"),
    (28, "007", "母乳收集及配件"),
    (29, "006", "乳頭護理系列"),
    (31, "005", "吸乳器005"),
    (32, "004", "鋁箔"),
    (33, "003", "保鮮膜"),
    (34, "002", "愛樂購"),
    (35, "APP", "衛生紙"),
    (36, "8DA4", "8DA4 掛鉤DIY膠"),
    (40, "WN", "WN"),
    (41, "HESS", "HESS"),
    (42, "O-BW", "O-BW"),
    (43, "BASF", "BASF"),
    (44, "001", "001"),
    (45, "8CB4", "居家清潔劑(3M/魔利)"),
    (46, "8EE5", "工作手套(3M DIY)"),
    (47, "8FF5", "8FF5"),
    (48, "85C4", "膠帶及封箱用品(3M)"),
    (49, "FG01", "FG01"),
    (50, "BL1", "BL1"),
    (55, "8HH5", "汽車美容清潔用品(3M)"),
    (56, "010", "益生菌保健食品"),
    (57, "TISSUE", "衛生紙及紙品(舒潔/可麗舒)"),
    (58, "DIAPER", "紙尿褲/褲型尿布(好奇)"),
    (59, "FEMCARE", "女性衛生棉/護墊/成人褲(靠得住)"),
    (60, "KC-GIFT", "品牌玩具/週邊贈品(好奇/靠得住)"),
    (61, "KCP-WIPE", "工業擦拭布及防護用品(金百利專業)"),
    (62, "WETWIPE", "濕巾/濕式衛生紙(好奇/舒潔)"),
    (64, "COSMETIC", "美妝保養品(Dr.Cink等)"),
    (65, "OTC-DRUG", "指示藥品/成藥"),
    (66, "ORAL-HC", "口腔清潔及居家清潔用品"),
    (67, "SUPPLEMENT", "保健食品"),
    (68, "BABYCARE2", "嬰幼兒沐浴保養品(非P&G品牌)"),
    (69, "MEDSUPPLY", "醫療耗材/傷口護理用品"),
    (70, "MEDNUTRI", "特殊營養配方食品"),
    (71, "SNACK", "零食/休閒食品"),
    (72, "KITCHEN", "廚房生活小物"),
    (74, "PET", "寵物用品"),
    (75, "FEMCARE2", "女性衛生棉/成人紙尿褲(多品牌混合)"),
    (77, "GIFT", "促銷贈品(多品牌)"),
    (81, "TEST-HH", "日用品(疑似測試資料)"),
    (82, "TEST-SNK", "零食(疑似測試資料)"),
    (83, "SEAFOOD-MEAT", "生鮮/凍藏食材批發(海鮮.肉品.乾貨)"),
    (84, "FOOD-WHOLESALE", "食品雜貨/冷凍調理食品(晨家等品牌)"),
    (85, "MUCHENSHI", "居家清潔抹布/除塵紙(無塵氏)"),
    (86, "WETWIPE-OTHER", "濕巾/化妝棉(其他品牌)"),
    (87, "APPLIANCE-COLOR", "小家電/生活家電(色碼系列)"),
    (88, "LAUNDRY", "洗衣球/洗衣用品"),
    (89, "STATIONERY", "文具/曆本禮品(讀曆書店)"),
    (90, "PACKAGING", "包材/寄件紙箱/提袋"),
    (91, "GIFTBOX-FOOD", "年節禮盒/年菜"),
    (92, "MISC-GADGET", "小家電/生活雜貨(其他)"),
    (93, "ADULT-INCONT", "成人紙尿褲/看護褲(自由適)"),
]

# Keyword rules in order, the first that matches wins; -1 marks test data.
KEYWORD_RULES = [
    (r"測試商品", -1),
    (r"好奇.*(磁性板|收納箱|泡泡相機|滾球|轉轉樂|嚕嚕車|七巧板|電子琴畫板|玩具)", 60),
    (r"好奇.*(濕巾|純水)", 62),
    (r"好奇", 58),
    (r"舒潔.*(濕式|濕巾)|Kleenex.*(濕式|濕巾|卸妝)", 62),
    (r"舒潔|可麗雅|可立雅|可麗舒|Kleenex|OEM.*衛生紙|家樂福.*衛生紙|統一超商.*衛生紙", 57),
    (r"靠得住|Kotex", 59),
    (r"自由適", 93),
    (r"三面電動牙刷", 16),
    (r"丁晴手套|防護衣|工業用紙|Scott|WypAll|AQUARIUS", 61),
    (r"JIGOTT|theSAEM|Prreti|面膜|精華[液露]|眼霜|眼膜|面霜|唇膜|唇線筆|遮瑕|去角質|安瓶|燕窩禮盒|舒敏.*潔膚|護手霜|沐浴露|積雪草|黃金膠原|蘆薈舒緩保濕凝膠", 64),
    (r"寶兒樂|寵物", 74),
    (r"洗衣膠球|洗衣球|蘭諾衣物芳香豆|去漬液", 88),
    (r"^KA[-\d]|^RM-\d|^KK[-\d]|^AD-\d|^\d{5}-\d{2}(芥末黃|淺灰|火山灰|湖藍|啡紅|翡翠綠|櫻花粉|灰綠)|隨行果汁機", 87),
    (r"讀曆|拾光造字本|超能曆|種子曆", 89),
    (r"寄件紙箱|不織布帶扣提袋|紙袋", 90),
    (r"無塵氏", 85),
    (r"拭拭樂|悅拭美|悅仕美|惜福品|比得兔|酷洛米.*方巾|涼感巾|涼感毛巾|化妝棉|純水.*方巾|卸妝濕巾|迷你濕巾", 86),
    (r"晨家|呷米|Kai康普茶|米啤酒|澎湖啤酒|紅點啤酒|高粱|蘭陽食品|有機紅茶豆奶", 84),
    (r"^[一-龥]-", 84),
    (r"Litheli|FunPeak|Washwow|Byee|Tia-One|格外美|不落枕|藍光手持式消毒噴霧槍|Ｋ５ＰＲＯ|折疊蛋捲桌|香氛蠟燭|香氛擴香瓶", 92),
    (r"禮盒|年菜|佛跳牆", 91),
    (r"豌豆|蠶豆|香脆.*豆", 71),
    (r"蝦|魚|蟹|蟳|貝|軟絲|小卷|魷魚|章魚|干貝|鮑|扇貝|海蜇|海參|牡蠣|生蠔|文蛤|鱈|鮭|鯛|鯖|秋刀|旗魚|鰹魚|鰻|龍蝦|紅條|紅板|白昌|白足|白仁|大頭|二頭|老A|大A|市足|市肉|市身|太陽|角蝦|飛魚卵|鱙魚|虱目魚|牛|豬|雞|肉品|腱|五花|骨腿|大腸頭|條肉|棒棒腿|三節翅|沙朗|炭烤|德國豬腳|清腿|前腿心|板腱|帝王蟹|珠貝|海麻仁|海瓜子|香菇|菇|玉米|洋甘菊|冬瓜|地瓜|米菓|米果|散裝|花枝|鳴戶卷|姬路城|錦絲|和尚頭|石班|透抽|生片|熟卷|盒[卷捲]|英哥|大武|中尖|中紅|大紅|小花枝|中母市|母市|公市|中公|大公|白秋|南尤|紫御|培根|火鍋料|昆布|裙帶|甜不辣|土托|龍肉|預打泥|抽[\s(#\d]|A抽|特大抽|中抽|中大抽|扁雪片|竹筍|杏仁|枸杞|黑木耳|藜麥|海帶|烤麩|丁香|蓮藕|草猴|白猴|海鮮筒|海鮮卷|金鑽酥|燒賣|湯包|煎餃|手工肉羹|華昇|金線|印度.*漿|MEENA|NAIK|SeaStar|Yashaswi|OCEAN|UTTAM|SILVER|ODYSSEY|板燒|玉子|豆腐燒|蛋皮|佃煮|羔羊|冷凍腿肉|白米|東門|烏龍麵|青花椒鹽|團膳|明月冰卷|南瓜|圓芝士豆腐|小石支|芝心包|市.*紅市|^\(\d+[-/]|^\(\d+\)|K\)\s*\d", 83),
    (r"零食|軟糖|爆米花|餅乾|喉糖|QQ糖", 71),
]

# Forecasting, slotting and picking parameters.
ABC_A, ABC_B = 80.0, 95.0
PAIR_COUNTS = [(3000, 3, 5), (20000, 10, 15), (None, 20, 30)]  # (orders below, pair count, count for lift)
CLUSTER_LIFT = 1.3
MATRIX_CAP = 20
TEST_MONTHS, TEST_WEEKS = 3, 13
SES_ALPHA, HOLT_ALPHA, HOLT_BETA, CROSTON_ALPHA = 0.3, 0.3, 0.15, 0.1
LOOK_BACK = 6
SEASON = 12
MIN_TRAIN = 4  # periods before the horizon that a forecast needs
RECENT_PERIODS = 3
SLOT_AREA = 2.0
FAR_AWAY = 9999.0
CAPACITY, WAVE_THRESHOLD = 20, 5
WALK_SPEED, HANDLE_SECONDS = 1.0, 12.0
KPI_TARGETS = {"dist": 10.0, "rounds": 10.0, "worktime": 5.0}
PARETO_POINTS = 220
MODELS = ["Naive", "季節Naive", "MA3", "SES", "Holt", "Croston"]

# Names of an export's sheets, in their order.
SHEETS = {"clean": "乾淨資料", "isolated": "隔離資料", "categories": "商品類別對應表", "changes": "逐筆變更紀錄", "items": "商品材積主檔"}

# Fixed values of floor plans: side of a grid cell, and the lines between halls (y) with the gates (from x, to x) through them.
GRID_STEP = 12.0
GATES = {985.0: [(865.0, 1000.0), (1430.0, 1558.0)], 1278.0: [(808.0, 1012.0)]}
