"""Input contracts, readers, writers, staging and the test-table adapter."""
