"""Word lists, labels, thresholds and patterns that results depend on."""

from __future__ import annotations

# Labels of a match, in order, and the totals from which the first two hold.
RECOMMEND = ("推荐", "待定", "不推荐")
RECOMMEND_FROM, PENDING_FROM, LEAST_TOTAL = 80, 60, 20
MUST_WEIGHT, BONUS_WEIGHT = 0.7, 0.3
SYSTEM_SOURCE = "系统匹配"
OPEN_STATUS = "招聘中"
NO_DEPARTMENT = "未填部门"
UNJUDGED = "未判定"
NOTHING = "无"

# Levels of education, and aliases in the order in which they are tried.
LEVELS = {"博士": 4, "硕士": 3, "本科": 2, "大专": 1}
DEGREE_ALIASES = (("博士", ("博士",)), ("硕士", ("硕士", "研究生")), ("本科", ("本科", "学士")), ("大专", ("大专", "专科", "高职", "中专")))

# Segments of gates and of structured résumés, and what fills a missing one.
GATE_SEGMENTS = ("学历", "专业", "经验", "证书", "年龄")
GATE_ABSENT = "不作硬性要求"
SEGMENT_ABSENT = "未提及"

# Lines of a refined résumé, cells that a refinement may correct, cells of an opening that it may write, those of
# them that mark an opening as refined.
RESUME_SEGMENTS = ("学历背景", "工作经验", "核心技能", "求职意向", "匹配度评估")
CORRECTIONS = ("name", "major", "school", "certificates", "years_experience", "expected_position")
JOB_KEYS, JOB_REFINED = ("hard_gates", "must_skills", "bonus_skills", "work_location", "org", "status"), ("hard_gates", "must_skills", "bonus_skills")

# Keys of a report in the order in which they are shown, those that come last, cells of a row in its summary.
REPORT_HEAD = (
    "user_line", "next_action", "created", "readback_missing", "table_total", "refine_queued", "cron_job", "created_summary", "total", "parsed", "skipped_dup", "needs_ocr",
    "backfill_stripped", "failed", "duplicates_removed",
)
REPORT_TAIL, SUMMARY_ROWS = ("error", "timing_ms"), 5
SUMMARY_FIELDS = ("name", "phone", "expected_position", "school", "major", "education", "years_experience", "job_name", "department")

# Cities, departments and their aliases, organisations.
CITIES = ("北京", "上海", "深圳", "杭州", "成都", "广州", "南京", "武汉", "曲靖", "不限")
ANYWHERE = "不限"
DEPARTMENTS = (
    "技术部", "产品部", "市场部", "运营部", "厂务管理部", "EHS管理部", "单晶制造部-生产部", "单晶制造部-设备部", "数据信息部-系统组",
    "财经管理部", "硅片制造部-工艺部", "硅片制造部-设备部", "组件制造部-工艺部", "组件制造部-设备部", "电池制造部-工艺部", "电池制造部-设备部",
    "厂务管理部-暖通组", "厂务管理部-电力能源组",
)
DEPARTMENT_ALIASES = {"电池设备部": "电池制造部-设备部", "电池工艺部": "电池制造部-工艺部", "电池制造部-电池设备部": "电池制造部-设备部"}
ORGANISATIONS = ("职能中心", "制造中心", "营销中心", "研发中心")
DEFAULT_ORGANISATION = "制造中心"

# Skills that are looked for in texts.
SKILLS = (
    "暖通", "PLC", "CAD", "电气", "设备运维", "设备管理", "工艺", "切片", "镀膜", "组件", "电池", "硅片", "单晶", "拉晶", "EHS", "安全管理", "财务", "成本",
    "预算", "Python", "Java", "SQL", "Excel", "SAP", "MES", "ERP", "自动化", "机电", "机械", "焊接", "电工", "点检", "TPM", "精益", "六西格玛", "SPC", "质量管理",
    "ISO9001", "数据分析", "SolidWorks", "西门子", "三菱", "欧姆龙", "变频器", "伺服", "光伏", "半导体", "扩散", "PECVD", "丝网印刷", "层压", "串焊", "排程",
    "项目管理", "团队建设", "Office", "Word", "PPT", "账务", "税务", "审计", "报表", "会计", "出纳", "高压", "特种设备", "消防",
)

# Schools of two lists, categories of positions with their key words.
SCHOOLS_985 = (
    "清华大学", "北京大学", "复旦大学", "上海交通大学", "浙江大学", "南京大学", "中国科学技术大学", "哈尔滨工业大学", "西安交通大学", "武汉大学",
    "华中科技大学", "中山大学", "同济大学", "天津大学", "东南大学", "北京航空航天大学", "北京理工大学", "大连理工大学", "吉林大学", "山东大学",
)
SCHOOLS_211 = (
    "北京邮电大学", "华北电力大学", "河海大学", "江南大学", "苏州大学", "南京理工大学", "南京航空航天大学", "西安电子科技大学", "合肥工业大学", "郑州大学",
    "南昌大学", "太原理工大学", "云南大学", "贵州大学", "广西大学", "西南交通大学", "电子科技大学", "中南大学", "湖南师范大学", "长安大学",
)
CATEGORIES = (
    ("技术类", ("工程师", "技术", "设备", "工艺", "电气", "暖通", "研发", "维修", "PLC", "切片", "镀膜", "电池", "组件", "硅片", "单晶", "EHS", "安全")),
    ("产品类", ("产品", "产品经理", "产品运营")),
    ("市场类", ("市场", "销售", "商务", "营销", "客户")),
    ("运营类", ("运营", "财务", "会计", "成本", "人力", "行政", "供应链", "采购")),
)
OTHER_CATEGORY = "其他"

# File kinds, sizes of batches.
TEXT_KINDS, DOC_KINDS, IMAGE_KINDS = ("txt", "md"), ("doc", "docx", "pdf"), ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff")
MOST_PARTS, BLOCK_ROWS = 20, 8
#: Words hit and missed that a line of evidence lists.
MOST_HITS, MOST_MISSES = 8, 6

# Lengths from which an observation is made.
EVIDENCE_LONG, ANALYSIS_RANGE, TAG_LONG, TAG_HAN_RANGE = 200, (150, 250), 12, (2, 6)

# Words that mean the same.
SYNONYMS = (
    ("成本管控", "成本控制", "降本改善", "降本增效", "费用管控"),
    ("节能改造", "节能降耗", "降耗", "提产降耗"),
    ("团队管理", "班组管理", "带班", "人员管理", "团队建设", "团队带领"),
    ("人员培训", "技能培训", "培训带教", "人才建设", "人员培养"),
    ("预防性维护", "设备保养", "保养维修", "定期检测", "计划保养"),
    ("点检管理", "设备点检", "日常点检", "设备巡检", "巡检", "点巡检"),
    ("设备维修", "设备检修", "维修维护", "故障维修", "电气故障维修", "机械维修"),
    ("故障分析", "异常分析", "故障诊断", "故障排查", "原因分析"),
    ("设备改造", "技改项目", "升级改造", "设备改进", "优化改造", "自动化改造"),
    ("台账管理", "设备台账", "台账归档", "资料归档", "文档管理"),
    ("作业指导书", "SOP建设", "作业标准", "工艺文件", "操作规程", "规程修订", "标准建设"),
    ("生产计划", "排产", "计划排产", "生产调度", "任务分配"),
    ("良率管理", "良率管控", "良率改善", "良率提升", "一次合格率", "质量管控"),
    ("碎片率", "崩边", "不良分析", "缺陷分析"),
    ("设备安装调试", "安装调试", "装机调试", "设备调试", "开线调试"),
    ("产线开线", "开线", "首线开线"),
    ("产线筹建", "建厂", "海外基地建厂", "车间筹建", "前期筹备"),
    ("电气图纸", "电气设计", "图纸审核", "设计提资"),
    ("工作票", "操作票", "两票制度"),
    ("安全管理", "安全生产", "安全管控", "现场安全", "安全技术"),
    ("隐患排查", "隐患治理", "安全隐患排查", "安全检查"),
    ("危险源辨识", "风险辨识", "危险源评价"),
    ("应急管理", "应急预案", "应急演练", "事故演习"),
    ("特种设备管理", "特种设备档案"),
    ("计量校准", "计量体系", "校准计划"),
    ("备件管理", "备品备件", "备件管控", "库存管控"),
    ("5S管理", "6S管理", "现场6S", "7S管理"),
    ("MES运维", "MES", "mes系统", "制造系统运维"),
    ("SQL", "SQL查询", "数据查询"),
    ("帆软报表", "FineReport", "报表开发", "BI报表", "可视化报表"),
    ("数据看板", "看板开发", "驾驶舱", "BI看板"),
    ("CAD", "AutoCAD制图", "工程制图", "制图"),
    ("PLC", "PLC编程", "程序调试", "PLC控制"),
    ("项目管理", "项目主导", "项目统筹", "项目全周期管理", "项目规划"),
    ("跨部门协同", "沟通协调", "部门对接", "跨部门沟通"),
    ("EHS管理", "环境健康安全", "EHS体系"),
    ("数据分析", "工艺数据分析", "数据统计", "数据处理"),
    ("预算", "预算管理", "预算编制", "成本预算"),
    ("稼动率提升", "OEE提升", "开机率提升", "设备效率提升"),
    ("三标体系", "ISO体系", "管理体系建设", "制度体系建设"),
)

# General words of an opening, and the special words of a candidate that satisfy them.
HYPERNYMS = {
    "光伏设备": ("单晶炉", "切片机", "插片机", "清洗机", "丝网印刷机", "印刷设备", "镀膜设备", "PECVD", "湿法设备", "组件设备", "层压设备", "焊接设备", "IV测试", "扩散", "制绒", "刻蚀", "单晶炉集控"),
    "光伏工艺": ("拉晶工艺", "切片工艺", "组件工艺", "电池工艺", "镀膜工艺", "丝网印刷工艺", "湿法工艺", "制绒", "刻蚀", "扩散", "层压", "焊接", "多晶硅清洗", "酸洗", "正背膜"),
    "暖通": ("空调系统", "暖通空调", "转轮除湿机", "高效机房", "温湿度控制"),
    "空调系统": ("转轮除湿机", "高效机房", "暖通", "FFU"),
    "排风系统": ("除尘设备", "废气处理", "新风系统"),
    "废气处理": ("排风系统", "除尘设备", "RTO"),
    "冷却水系统": ("PCW", "空压机", "循环水", "高效机房"),
    "设备管理": ("设备点检", "设备保养", "设备维修", "设备改造", "台账管理", "备件管理", "预防性维护", "检修计划"),
    "设备全生命周期": ("设备选型", "设备维修", "验收", "报废处置", "安装调试"),
    "供配电运维": ("变电站运维", "倒闸操作", "送电", "电气施工管理", "配电室管理"),
    "电气图纸": ("电气设计", "图纸审核"),
    "安全管理": ("安全生产", "三级安全教育", "安全资料归档", "消防管理", "6S管理"),
    "团队管理": ("班组管理", "人员培训", "技能培训", "带班", "绩效考核"),
    "特种作业证": ("高压电工证", "低压电工证", "电工证", "焊工证", "防爆证", "高级电工职业技能证书"),
    "电工证": ("高压电工证", "低压电工证", "高级电工职业技能证书", "特种作业操作证"),
    "系统运维": ("MES运维", "权限配置", "系统监控", "工单处理"),
    "数据采集": ("ETL", "点表调试", "设备联网", "多源异构采集"),
    "财务核算": ("总账处理", "账务处理", "成本核算", "合并报表"),
    "成本核算": ("财务核算", "存货盘点", "成本分析", "账务处理"),
    "生产管理": ("生产计划", "排产", "现场管理", "车间管理", "班组管理"),
    "自动化": ("PLC", "工业机器人", "智能仓储", "伺服"),
}
