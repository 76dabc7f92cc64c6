"""Declared schemas of stored tables and landed files."""

from __future__ import annotations

NEWS = (
    "id string, title string, summary string, url string, source string, published timestamp_ntz, origin string, "
    "language string, source_country string"
)
EVENT = (
    "event_type string, location string, country_code string, port_code string, severity int, start_date date, "
    "end_date date, industries array<string>, summary string, confidence double, event_id string, news_id string, "
    "source_url string, source_name string, published timestamp_ntz, model string, prompt_version string"
)
RECORD = (
    f"news_id string, model string, prompt_version string, status string, is_disruption boolean, "
    f"events array<struct<{', '.join(f'{p.split()[0]}: {p.split()[1]}' for p in EVENT.split(', '))}>>, error string"
)
REPLY_EVENT = (
    "struct<event_type: string, location: string, country_code: string, port_code: string, severity: string, "
    "start_date: string, end_date: string, industries: array<string>, summary: string, confidence: string>"
)
REPLY = f"is_disruption boolean, events array<{REPLY_EVENT}>"
GOLD = (
    "news_id string, is_disruption boolean, events array<struct<event_type: string, location: string, "
    "country_code: string, port_code: string, severity: int>>, label_source string"
)
# Fixed order of the labelling sheet's columns.
SHEET_COLUMNS = (
    "news_id", "source", "published", "title", "text", "url", "is_disruption", "event_type", "location", "country_code",
    "port_code", "severity", "notes", "label_source", "draft_model",
)
PORTS = "locode string, name string, country_code string, region string, lat double, lon double, aliases string"
WAYPOINTS = "node_id string, name string, kind string, lat double, lon double, country_code string, aliases string"
LEGS = "from_node string, to_node string"
LANES = "lane_id string, origin string, destination string, focus string"
# Fixed mapping: raw order-export column -> our name.
ORDER_COLUMNS = {
    "order date (DateOrders)": "order_date", "Days for shipping (real)": "days_real",
    "Days for shipment (scheduled)": "days_scheduled", "Late_delivery_risk": "late", "Shipping Mode": "shipping_mode",
    "Market": "market", "Order Region": "order_region", "Order Country": "order_country",
    "Customer Segment": "customer_segment", "Category Name": "category", "Department Name": "department",
    "Type": "payment_type", "Order Item Quantity": "quantity", "Order Item Product Price": "unit_price",
    "Order Item Discount Rate": "discount_rate", "Sales": "sales",
}
