"""Fleet audit: findings and reports over catalog snapshots and logs of many database servers."""
