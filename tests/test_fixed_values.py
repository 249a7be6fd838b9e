"""The texts and lists that the queries share with their SQL, written out again: a change here is a change of results."""

from stayline import catalogue
from stayline.operators import explore, offers, scenarios
from stayline.sources import exports

# Fixed values.
CHURN_FEATURES = ('Age',
 'MembershipPeriod',
 'VisitFrequency',
 'AvgSessionTime',
 'PagesViewed',
 'PurchaseFrequency',
 'AvgOrderValue',
 'TotalSpent',
 'LastPurchaseDaysAgo',
 'DiscountUsed',
 'CustomerSatisfaction',
 'ReturnCount',
 'ComplaintHistory',
 'CartAbandonRate',
 'Gender_enc',
 'Location_enc',
 'Category_enc',
 'AppUsage_enc')

# Fixed values.
CLV_FEATURES = ('Age',
 'MembershipPeriod',
 'PurchaseFrequency',
 'AvgOrderValue',
 'TotalSpent',
 'CustomerSatisfaction',
 'ReturnCount',
 'VisitFrequency',
 'DiscountUsed')

# Fixed values.
RFM_FEATURES = ('LastPurchaseDaysAgo', 'PurchaseFrequency', 'TotalSpent', 'CustomerSatisfaction', 'CLV')

# Fixed values.
FEATURE_NAMES = {'CartAbandonRate': 'Cart Abandon Rate',
 'CustomerSatisfaction': 'Customer Satisfaction',
 'LastPurchaseDaysAgo': 'Last Purchase (days)',
 'ComplaintHistory': 'Complaint History',
 'TotalSpent': 'Total Spent',
 'PurchaseFrequency': 'Purchase Frequency',
 'AvgOrderValue': 'Avg Order Value',
 'MembershipPeriod': 'Membership Period',
 'VisitFrequency': 'Visit Frequency',
 'Age': 'Age',
 'AppUsage_enc': 'App Usage',
 'Location_enc': 'Location',
 'Category_enc': 'Category',
 'Gender_enc': 'Gender',
 'AvgSessionTime': 'Avg Session Time',
 'PagesViewed': 'Pages Viewed',
 'ReturnCount': 'Return Count',
 'DiscountUsed': 'Discount Used'}

# Fixed values.
HISTOGRAM_COLUMNS = ('Age', 'CustomerSatisfaction', 'LastPurchaseDaysAgo', 'ComplaintHistory', 'CartAbandonRate', 'TotalSpent')

# Fixed values.
FULL_TEXTS = {'premium_win_back': ('🎁 Premium Win-Back',
                      ('30% discount on next 3 orders',
                       'Free priority shipping 3 months',
                       'VIP membership upgrade',
                       'Curated {category} deals')),
 'win_back': ('💌 Win-Back Campaign',
              ('20% discount (7 days)',
               'Free shipping next order',
               'New {category} arrivals',
               '200 loyalty points')),
 'urgent': ('⚠️ Urgent Retention',
            ('25% discount this week',
             'Double loyalty points',
             'Free express delivery 1 month',
             'Early sale access')),
 'nudge': ('🔔 Gentle Nudge',
           ('15% off next purchase',
            'Top {category} picks',
            'Loyalty points bonus',
            '48-hr flash sale invite')),
 'loyalty': ('⭐ Loyalty Reward',
             ('Free Gold membership 3 months',
              'Member-only discounts',
              'Early product launch access',
              'Refer & earn ₹500')),
 'champions': ('🏆 Champions Perk',
               ('Champions Club invitation',
                'Personal shopping assistant',
                'Limited edition early access',
                'Gift voucher ₹2000'))}

# Fixed values.
SHORT_TEXTS = {'lost_high': '30% discount + Free shipping + VIP upgrade',
 'lost': '20% coupon + Free shipping + {category} picks',
 'at_risk_high': '25% off + Double points + Express delivery',
 'at_risk': '15% off + {category} top picks + Flash sale',
 'loyal': 'Gold membership + Exclusive discounts',
 'other': 'Champions Club invite + Gift voucher ₹2000'}

# Fixed values.
SINGLE_TEXTS = {'premium_win_back': ('🎁 Premium Win-Back Offer',
                      ('30% discount on next 3 orders',
                       'Free priority shipping for 3 months',
                       'Exclusive VIP membership upgrade',
                       'Curated {category} deals'),
                      'High-value lost customer. Aggressive win-back recommended.'),
 'win_back': ('💌 Win-Back Campaign',
              ('20% discount coupon (valid 7 days)',
               'Free shipping on next order',
               'New {category} arrivals handpicked',
               '200 reactivation loyalty points'),
              'Customer has churned. Send re-engagement email immediately.'),
 'urgent': ('⚠️ Urgent Retention Offer',
            ('25% discount this week',
             'Double loyalty points',
             'Free express delivery for 1 month',
             'Early access to upcoming sale'),
            'High churn probability. Immediate intervention needed.'),
 'nudge': ('🔔 Re-Engagement Nudge',
           ('15% off next purchase',
            'Top {category} picks for you',
            'Loyalty points expiry bonus',
            '48-hour flash sale invite'),
           'Customer is drifting. A gentle nudge should bring them back.'),
 'loyalty': ('⭐ Loyalty Reward',
             ('Free Gold membership for 3 months',
              'Member-only exclusive discounts',
              'Early product launch access',
              'Refer & earn ₹500'),
             'Loyal customer. Reward and strengthen the relationship.'),
 'champions': ('🏆 Champions Club Invite',
               ('Champions Club invitation',
                'Personal shopping assistant',
                'Limited edition early access',
                'Annual gift voucher ₹2000'),
               'Top-tier customer. Keep them engaged with exclusive perks.')}

# Fixed values.
URGENCY = {'premium_win_back': 'CRITICAL',
 'win_back': 'HIGH',
 'urgent': 'HIGH',
 'nudge': 'MEDIUM',
 'loyalty': 'LOW',
 'champions': 'LOW'}

# Fixed values.
ACTIONS = (('Give Discount', {'disc': 1}),
 ('Satisfaction → 5', {'satisfaction': 5}),
 ('Satisfaction → 4', {'satisfaction': 4}),
 ('Cart Abandon → 0.1', {'cart_abandon': 0.1}),
 ('Visit Frequency +5', {'visit_freq_add': 5}),
 ('Last Purchase → 7 days', {'last_purchase': 7}),
 ('Complaints → 0', {'complaint_hist': 0}),
 ('All Actions Combined',
  {'disc': 1,
   'satisfaction': 5,
   'cart_abandon': 0.1,
   'visit_freq_add': 5,
   'last_purchase': 7,
   'complaint_hist': 0}))

# Fixed values.
BULK_COLUMNS = ('CustomerID',
 'Gender',
 'Age',
 'Location',
 'PreferredCategory',
 'TotalSpent',
 'CustomerSatisfaction',
 'ChurnProbability',
 'ChurnStatus',
 'PredCLV',
 'Segment',
 'RetentionOffer')

# Fixed values.
TOP_RISK_COLUMNS = ('CustomerID',
 'Age',
 'Location',
 'PreferredCategory',
 'TotalSpent',
 'ChurnProbability',
 'PredCLV',
 'Segment',
 'RetentionOffer')


def test_shared_values():
    assert catalogue.CHURN_FEATURES == CHURN_FEATURES
    assert catalogue.CLV_FEATURES == CLV_FEATURES
    assert catalogue.RFM_FEATURES == RFM_FEATURES
    assert catalogue.FEATURE_NAMES == FEATURE_NAMES
    assert explore.HISTOGRAM_COLUMNS == HISTOGRAM_COLUMNS
    assert offers.FULL_TEXTS == FULL_TEXTS
    assert offers.SHORT_TEXTS == SHORT_TEXTS
    assert offers.SINGLE_TEXTS == SINGLE_TEXTS
    assert offers.URGENCY == URGENCY
    assert scenarios.ACTIONS == ACTIONS
    assert exports.BULK_COLUMNS == BULK_COLUMNS
    assert exports.TOP_RISK_COLUMNS == TOP_RISK_COLUMNS
