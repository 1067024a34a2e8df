"""Index objects: what a user builds, searches, changes and saves."""
