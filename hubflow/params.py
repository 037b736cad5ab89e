"""Fixed values of the reports: ids, labels, patterns, hours and name lists.

Report functions take dates, clients, hubs and provinces as arguments; the
values below are those a caller passes to get the established reports.
"""

from __future__ import annotations

from datetime import date

# --- fixed values: clients ------------------------------------------------
CLIENT_SPE = 18692
CLIENT_SPB = 3892833
CLIENT_TTSE = 3819710
CLIENT_TTSB = 4447237
CLIENT_GROUPS = {CLIENT_SPE: "SPE", CLIENT_SPB: "SPB", CLIENT_TTSE: "TTSE", CLIENT_TTSB: "TTSB"}
EXCLUDED_CLIENTS = (2781603, 2590595, 224845, 9794, 1367)
SMALL_CLIENT = "SME"
EXCLUDED_GROUP = "OTHER_EXCLUDED"
MARKET_LABELS = {"Shopee": (CLIENT_SPE, CLIENT_SPB), "TikTokShop": (CLIENT_TTSE, CLIENT_TTSB)}
OTHER_MARKET = "Khác"
MEASURED_CLIENTS = {CLIENT_TTSE: "TTS_Exp", CLIENT_TTSB: "TTS_Bulky"}
BULKY_CHANNEL = "Shopee Bulky"
PICKUP_CLIENTS = ("18692", "3892833")
SAMPLED_CLIENT_TYPES = ("SPE", "SPB", "TTSE", "TTSB")

# --- fixed values: statuses and log actions ---------------------------------
TERMINAL_STATUSES = ("delivered", "returned", "return", "lost", "scrap")
JOURNEYS = {"delivered": "deli", "returned": "return"}
CANCELLED = "cancel"
RETURN_MARKER = "return"
UNPACK, RECEIVE, EXPORT = "unpack", "receive", "export"
RECEIVE_ACTION = "RECEIVE_PACKAGE"
VEHICLE_ARRIVE = "VEHICLE_ARRIVE"
PICK_ITEM = "PICK"
STAFF_INCIDENT = "Nhân viên gặp sự cố"

# --- fixed values: hubs -----------------------------------------------------
TRANSIT_HUB = "KTC"
EXCLUDED_HUB_MARKER = "Ahamove"
KEY_ACCOUNT_MARKER = "Key Account"
HUB_XA, HUB_HY = "1626", "21365000"
EARLY_CUTOFF_PROVINCES = (201, 202)
EARLY_CUTOFF_HOUR, CUTOFF_HOUR = 8, 9
NETWORK_HOUR, LOCAL_HOUR = 15, 21
LATE_ORDER_HOUR = 19
HEAVY_GRAMS = 20000
HEAVY, LIGHT = "hang_nang", "hang_nhe"

# --- fixed values: sorter actions and the JSON fields they fill -------------
SORTING, WEIGHING = "SORTING_PARCEL", "WEIGHING_PARCEL"
DWS, MATRIX = "DWS_PARCEL", "MATRIX_SCANNED_PARCEL"
WEIGHT_FIELDS = {SORTING: "feederWeight", WEIGHING: "weight", MATRIX: "dwsWeight"}
SIZE_FIELDS = {"length_mm": "dwsLength", "width_mm": "dwsWidth", "height_mm": "dwsHeight"}

# --- fixed values: time zones -----------------------------------------------
TRUCK_ZONE = "Asia/Bangkok"
LOCAL_ZONE = "Asia/Ho_Chi_Minh"

# --- fixed values: report dates and hub lists -------------------------------
WEEKLY_SINCE = date(2026, 5, 18)
PICKUP_SINCE = date(2026, 6, 1)
CLAIMS_SINCE = date(2025, 6, 15)
FAILED_CREATED_AFTER = date(2026, 1, 1)
FAILED_PICK_RANGE = (date(2026, 5, 1), date(2026, 5, 31))
FAILED_PARTITION_RANGE = (date(2025, 11, 1), date(2026, 5, 31))
FLAGGED_HUBS = (
    "Bưu Cục 73 Phó Cơ Điều-Phường Phước Hậu-Vĩnh Long",
    "Bưu Cục Thôn Chùa-Việt Yên-Bắc Giang",
    "Bưu Cục Tổ 1 TT Hương Sơn-Xã Phú Bình-Thái Nguyên",
    "Bưu Cục 992 Đường Huyện 35-Vĩnh Kim-Châu Thành-Tiền Giang",
    "Bưu Cục Quốc Lộ 50-Gò Công Tây-Tiền Giang",
    "Bưu Cục 77 Hoàng Quốc Việt-Mộc Châu-Sơn La",
    "(HYE) Mỹ Hào",
    "Bưu Cục Phố Mới-Thủy Nguyên-Hải Phòng",
    "Bưu Cục Khu Sơn Đông-Phường Nam Sơn-Bắc Ninh",
    "Bưu Cục Ngã Ba Khe-Văn Chấn-Yên Bái",
    "Bưu Cục 130 Trần Văn Lan-Q.Hải An-Hải Phòng",
    "Bưu Cục 83 Điện Biên Phủ-Xã Bum Tở-Lai Châu",
    "Bưu Cục 270 Phan Văn Mãng- Bến Lức-Long An",
    "Bưu Cục Cầu Thia-Nghĩa Lộ-Yên Bái",
    "Bưu Cục Gia Đông-Thuận Thành-Bắc Ninh",
    "Bưu Cục Chợ Ấp Đồn-Yên Trung-Yên Phong-Bắc Ninh",
    "Bưu Cục Cột 5-Hạ Long-Quảng Ninh",
    "Bưu cục Khu 4-Quan Hoá-Thanh Hoá",
    "Bưu Cục 102 Nguyễn Đăng Lành-Nam Sách-Hải Dương",
    "Bưu Cục An Dương 2-Hải Phòng",
)
BACKLOG_PROVINCES = ("Long An", "Bình Phước", "Đồng Nai", "Binh Phuoc", "Dong Nai")
BACKLOG_HUBS = (
    "Bưu Cục 1070 Quốc Lộ 51-TP. Biên Hòa-Đồng Nai",
    "Bưu Cục 55/3B Trần Quốc Toản-Phường Trấn Biên-Đồng Nai",
    "Bưu Cục Quốc Lộ 1A-Bắc Sơn-Trảng Bom-Đồng Nai",
    "Bưu Cục 79A Hưng Đạo Vương-Biên Hòa-Đồng Nai",
    "Bưu Cục 270 Phan Văn Mãng- Bến Lức-Long An",
    "Bưu Cục Agtex Long Bình-Biên Hoà-Đồng Nai",
    "Bưu Cục 76/540 KP8-Hố Nai-TP Biên Hòa-Đồng Nai",
    "Bưu Cục Tân Đồng-Đồng Xoài-Bình Phước",
    "Bưu Cục Ấp Cầu Xây-Xã Thủ Thừa-Long An",
    "Bưu Cục Phước Thiền-Nhơn Trạch-Đồng Nai",
    "Bưu Cục KDC Hóa An-Biên Hòa-Đồng Nai",
    "Bưu Cục Đường Hùng Vương-Xã Phước An-Đồng Nai",
)
