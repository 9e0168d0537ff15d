"""The tracker's own sample rows (its seed script), as the hand-checked
fixture. Times are relative to a frozen ``AS_OF``."""

import datetime as dt

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)


def days_ago(d):
    return AS_OF - dt.timedelta(days=d)


# fixed values: seed rows as given
USERS = [(1, "Sarah Chen", "sarah@company.com", "admin"), (2, "Marcus Webb", "marcus@company.com", "supervisor"),
         (3, "Aisha Patel", "aisha@company.com", "agent"), (4, "Tom Rivera", "tom@company.com", "agent"),
         (5, "Lily Nguyen", "lily@company.com", "agent")]
CLIENTS = [(1, "James Harmon", "+1-555-0101", "james@acme.com", "Acme Corporation"),
           (2, "Priya Sharma", "+1-555-0102", "priya@globaltech.com", "GlobalTech Ltd"),
           (3, "Carlos Mendez", "+1-555-0103", "carlos@nextgen.com", "NextGen Solutions"),
           (4, "Rachel Kim", "+1-555-0104", "rachel@prime.com", "Prime Retail Inc"),
           (5, "David Okafor", "+1-555-0105", "david@aurora.com", "Aurora Systems"),
           (6, "Emma Laurent", "+1-555-0106", "emma@vertex.com", "Vertex Partners"),
           (7, "Ravi Gupta", "+1-555-0107", "ravi@synapse.com", "Synapse AI"),
           (8, "Mia Chen", "+1-555-0108", "mia@orbit.com", "Orbit Media")]
CATEGORIES = [(1, "Delivery", None), (2, "Payment", None), (3, "Product Quality", None),
              (4, "Technical Support", None), (5, "Billing", None),
              (6, "Late Delivery", 1), (7, "Wrong Item", 1), (8, "Missing Package", 1),
              (9, "Refund Request", 2), (10, "Double Charge", 2), (11, "Defective Product", 3),
              (12, "Missing Parts", 3), (13, "Login Issues", 4), (14, "App Crashes", 4),
              (15, "Incorrect Invoice", 5)]
# id, client, agent, category, title, priority, status, counter, created days ago, updated days ago
NOTES = [(1, 1, 3, 1, "Package not delivered on time", "High", "Open", 7, 10, 2),
         (2, 2, 4, 2, "Payment failed at checkout", "High", "In Progress", 12, 9, 3),
         (3, 3, 3, 3, "Product arrived damaged", "Medium", "Open", 5, 8, 4),
         (4, 4, 5, 4, "App crashes on login screen", "High", "In Progress", 9, 15, 5),
         (5, 1, 3, 2, "Double charged for single order", "High", "Open", 3, 5, 1),
         (6, 2, 4, 3, "Wrong item shipped", "Medium", "Resolved", 4, 20, 10),
         (7, 3, 3, 3, "Missing parts in package", "Low", "Resolved", 2, 25, 14),
         (8, 4, 5, 4, "Password reset email not arriving", "Medium", "Resolved", 6, 30, 20),
         (9, 7, 4, 5, "Incorrect invoice amount", "Medium", "Open", 2, 4, 1),
         (10, 8, 3, 2, "Subscription renewal failed", "High", "In Progress", 8, 7, 2)]
# user, action, target id, target name, minutes ago
ACTIVITY = [(3, "increment_counter", 2, "Payment failed at checkout", 5),
            (4, "create_note", 4, "App crashes on login screen", 60),
            (1, "resolve_note", 6, "Wrong item shipped", 180),
            (3, "update_status", 1, "Package not delivered on time", 300),
            (4, "create_client", 5, "David Okafor", 1440),
            (2, "create_note", 5, "Double charged for single order", 2880),
            (3, "update_note", 3, "Product arrived damaged", 4320),
            (1, "increment_counter", 1, "Package not delivered on time", 5760)]


def load(spark):
    """DataFrames with the library's schemas."""
    from ticketlake import schemas
    users = spark.createDataFrame(
        [(i, n, e, r, True, AS_OF, AS_OF) for i, n, e, r in USERS], schemas.USERS)
    clients = spark.createDataFrame(
        [(i, n, p, e, c, True, sum(x[1] == i for x in NOTES), AS_OF, AS_OF) for i, n, p, e, c in CLIENTS], schemas.CLIENTS)
    categories = spark.createDataFrame(CATEGORIES, schemas.CATEGORIES)
    notes = spark.createDataFrame(
        [(i, c, a, k, t, None, p, s, n, None, days_ago(cr), days_ago(up))
         for i, c, a, k, t, p, s, n, cr, up in NOTES], schemas.NOTES)
    activity = spark.createDataFrame(
        [(j + 1, u, act, "note", tid, name, None, AS_OF - dt.timedelta(minutes=m))
         for j, (u, act, tid, name, m) in enumerate(ACTIVITY)], schemas.ACTIVITY_LOGS)
    return users, clients, categories, notes, activity
