"""Column expressions; nothing here touches a session or runs a job."""
