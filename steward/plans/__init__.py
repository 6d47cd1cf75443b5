"""From rule tables to one projection: rule resolution and compilation."""
