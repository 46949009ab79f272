"""voxledger.plans"""
