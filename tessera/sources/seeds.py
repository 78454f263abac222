"""The vocabulary every user starts with, as rows for a frame of users: one explode, no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (name, description).
NODE_TYPES = [("Person", "A real human person"), ("Organization", "A company, school, nonprofit, or other group"), ("Country", "A country"), ("City", "A city, town, or neighborhood"), ("Location", "A physical place — venue, building, base, stadium, campus, office, property, or address")]
#: Fixed values: (name, direction, inverse, type of source, type of target).
LINK_TYPES = [
    ("friend", "undirected", None, "Person", "Person"), ("colleague", "undirected", None, "Person", "Person"), ("classmate", "undirected", None, "Person", "Person"),
    ("sibling", "undirected", None, "Person", "Person"), ("spouse", "undirected", None, "Person", "Person"), ("co_investor", "undirected", None, "Person", "Person"),
    ("mentor", "directed", "mentee", "Person", "Person"), ("parent", "directed", "child", "Person", "Person"), ("employee", "directed", "employer", "Person", "Organization"),
    ("student", "directed", "alumni_school", "Person", "Organization"), ("advisor", "directed", "advisee", "Person", "Organization"), ("founder", "directed", "founded_by", "Person", "Organization"),
    ("customer", "directed", "customer_of", "Person", "Organization"), ("vendor", "directed", "vendor_of", "Person", "Organization"), ("lives_in", "directed", "resident", "Person", "City"),
    ("located_in", "directed", "location_of", "Organization", "City"), ("city_in", "directed", "contains_city", "City", "Country"), ("based_at", "directed", "base_of", "Person", "Location"),
    ("located_at", "directed", "location_of", "Organization", "Location"), ("held_at", "directed", "venue_of", None, "Location"), ("in_city", "directed", "contains_location", "Location", "City"),
    ("operated_by", "directed", "operates", "Location", "Organization"), ("contributor", "directed", "has_contributor", "Person", "Organization"), ("honorary_role", "directed", "has_honorary", "Person", "Organization"),
    ("served_in", "directed", "has_veteran", "Person", "Organization"), ("collaborated_with", "directed", "collaborator", "Person", "Organization"), ("guest_on", "directed", "has_guest", "Person", "Organization"),
    ("spoke_at", "directed", "speaker", "Person", None),
]
#: Fixed values: (name, colour).
TAGS = [("Personal", "#5E503F"), ("Work", "#22333B"), ("Family", "#a84432"), ("Investors", "#3a7a45")]


_COMM = '{"options":["formal","casual","witty","technical","warm","other"]}'
_KIND = '{"options":["company","school","nonprofit","government","investor","accelerator","other"]}'
_SIZE = '{"options":["1-10","11-50","51-200","201-1000","1001-5000","5000+"]}'
_PLACE = '{"options":["venue","office","building","base","campus","stadium","residence","property","landmark","other"]}'
#: Fixed values: (name, value type, configuration, of which type of node or link, attached by default, several values).
DETAIL_DEFINITIONS = [
    ("email", "text", None, "Person", "true", "true"), ("phone", "text", None, "Person", "true", "true"),
    ("birthday", "date", None, "Person", "true", "false"), ("location", "text", None, "Person", "true", "false"),
    ("linkedin_url", "url", None, "Person", "true", "false"), ("photo_url", "url", None, "Person", "true", "false"),
    ("where_we_met", "text", None, "Person", "true", "false"), ("pronouns", "text", None, "Person", "false", "false"),
    ("gender", "text", None, "Person", "false", "false"), ("twitter_handle", "text", None, "Person", "false", "false"),
    ("bio", "text", None, "Person", "false", "false"), ("interests", "text", None, "Person", "false", "true"),
    ("current_focus", "text", None, "Person", "false", "false"), ("seeking_to_meet", "text", None, "Person", "false", "false"),
    ("communication_style", "enum", _COMM, "Person", "false", "false"), ("assistant_preferences", "json", None, "Person", "false", "false"),
    ("kind", "enum", _KIND, "Organization", "true", "false"), ("website", "url", None, "Organization", "true", "false"),
    ("industry", "text", None, "Organization", "false", "false"), ("founded_year", "number", None, "Organization", "false", "false"),
    ("headquarters", "text", None, "Organization", "false", "false"), ("size", "enum", _SIZE, "Organization", "false", "false"),
    ("title", "text", None, "employee", "true", "false"), ("employee_start", "month_year", None, "employee", "true", "false"),
    ("employee_end", "month_year", None, "employee", "true", "false"), ("department", "text", None, "employee", "false", "false"),
    ("claimed_salary", "currency", '{"currency":"USD"}', "employee", "false", "false"), ("student_start", "month_year", None, "student", "true", "false"),
    ("student_end", "month_year", None, "student", "true", "false"), ("degree", "text", None, "student", "false", "false"),
    ("field_of_study", "text", None, "student", "false", "false"), ("location_kind", "enum", _PLACE, "Location", "true", "false"),
    ("address", "text", None, "Location", "true", "false"), ("city_name", "text", None, "Location", "false", "false"),
    ("description", "text", None, "Location", "false", "false"),
    *((n, "text", None, "Person", "false", "true") for n in ("life_event", "how_we_met", "food_preference", "allergy", "gift_idea", "gift_given", "gift_received", "favor_owed")),
]


def seeded(users: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """users(user_id) x rows; the rows are constants of the plan."""
    each = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r)]) for r in rows])
    return users.select("user_id", F.explode(each).alias("row")).select("user_id", "row.*")


def node_types(users: DataFrame) -> DataFrame:
    return seeded(users, NODE_TYPES, ["name", "description"])


def link_types(users: DataFrame) -> DataFrame:
    return seeded(users, LINK_TYPES, ["name", "direction", "inverse_name", "source_type", "target_type"])


def tags(users: DataFrame) -> DataFrame:
    return seeded(users, TAGS, ["name", "color"])


def detail_definitions(users: DataFrame) -> DataFrame:
    """One definition a user and name: of a name that is seeded twice the first counts."""
    return seeded(users, DETAIL_DEFINITIONS, ["name", "value_type", "value_config", "applies_to", "is_default", "multi_value"])
