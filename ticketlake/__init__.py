"""ticketlake: issue-tracker analytics as Spark DataFrame jobs.

Tables (users, clients, categories, notes, activity_logs, invitations) are
read or derived as DataFrames; every operator is a function from DataFrames
to a DataFrame, takes an explicit ``as_of`` where time matters, and never
collects data to the driver.
"""

from ticketlake.session import get_session, scratch_dir  # noqa: F401
from ticketlake.sources.tables import Tables, load_tables  # noqa: F401
